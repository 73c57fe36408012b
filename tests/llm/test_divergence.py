import re
from collections import Counter

import numpy as np
import pytest
from fixtures import SCHEMA, documents, frame, prose

from chainweave.llm import divergence as d


def corpus():
    return documents() + [(1000 + i, prose(1000 + i, 200), "en", "s0", 1) for i in range(60)]


def test_base_counts_against_brute_force(spark):
    got = {(r.doc_id, r.text): r for r in d.judged(frame(spark, corpus(), extra=("k0", "text_")), keep=("text", "k0", "text_")).collect()}
    for i, text, *_ in corpus():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        covered = {j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(k, k + 3)}
        lines = (text or "").split("\n")
        again = sum(1 for k, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:k])
        r = got[i, text]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert r.kept <= (not r.base_failed)


def test_junk_goes_and_prose_stays(spark):
    rows = [(i, prose(i, 200 + i), "en", "s", 1) for i in range(80)]
    letters = [prose(500 + i, 150) for i in range(6)]
    junk = [(200 + i, " ".join(w.upper() + "!!" for w in x.split()), "en", "s", 1) for i, x in enumerate(letters)]
    junk += [(300 + i, " | ".join(w for w in x.split() if len(w) > 4), "en", "s", 1) for i, x in enumerate(letters)]
    kept = {r.doc_id for r in d.judged(frame(spark, rows + junk)).where("kept").collect()}
    assert kept == {r[0] for r in rows}


def test_references_are_the_corpus(spark):
    rows = [(i, prose(i, 300), "en" if i % 2 else "de", "s", 1) for i in range(90)]
    refs = d.references(frame(spark, rows))
    for lang in ("en", "de"):
        texts = [r[1] for r in rows if r[2] == lang]
        words = Counter(w for t in texts for w in t.lower().split())
        chars, common, counts = refs[lang]
        assert chars.tolist() == sum(map(d.char_histogram, texts)).tolist()
        top = sorted(words.items(), key=lambda x: (-x[1], x[0]))[: d.COMMON]
        assert [w.decode() for w in common] == [w for w, _ in top] and counts[:-1].tolist() == [n for _, n in top]
        assert counts.sum() == sum(words.values())


def test_distance_bounds():
    assert d.distance(np.array([1, 0]), np.array([0, 3])) == 1 and d.distance(np.array([2, 2]), np.array([1, 1])) == 0
    assert d.distance(np.zeros(2), np.ones(2)) == 0


def test_empty(spark):
    assert d.judged(spark.createDataFrame([], SCHEMA)).collect() == []
    alone = d.judged(frame(spark, [(1, prose(1, 200), None, None, 1), (2, None, None, None, None)]))
    assert {r.doc_id: r.kept for r in alone.collect()} == {1: True, 2: False}


def test_a_language_without_reference_rejects_nothing(spark):
    rows = [(i, prose(i, 300), "en", "s", 1) for i in range(80)]
    other = ["".join(chr(ord(c) + 0x3B0 - 0x60) if c.isalpha() else c for c in " ".join(w + "q" for w in prose(500 + i, 150).split())) for i in range(6)]
    rare = [(200 + i, x, "el" if i % 2 else None, "s", 1) for i, x in enumerate(other)]
    labelled = [(300 + i, x, "en", "s", 1) for i, x in enumerate(other)]
    got = {r.doc_id: r for r in d.judged(frame(spark, rows + rare + labelled)).collect()}
    assert all(got[r[0]].kept and got[r[0]].word_distance > d.WORD_LIMIT for r in rare)
    assert not any(got[r[0]].kept for r in labelled)


def test_many_labels_take_no_language_away(spark, monkeypatch):
    monkeypatch.setattr(d, "MOST_LANGUAGES", 3)
    rows = [(i, prose(i, 300), "en", "s", 1) for i in range(60)] + [(1000 + i, "few words here", f"x{i}", "s", 1) for i in range(500)]
    refs = d.references(frame(spark, rows))
    assert list(refs) == ["en"] and refs["en"][2].sum() == 60 * 300


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(d, "MOST_LANGUAGES", 2)
    monkeypatch.setattr(d, "REFERENCE_WORDS", 100)
    rows = [(i, prose(i, 300), f"x{i % 3}", "s", 1) for i in range(9)]
    with pytest.raises(ValueError):
        d.references(frame(spark, rows))


def test_counts_are_handed_on_in_parts(spark, monkeypatch):
    rows = [(i, prose(i, 300), "en", "s", 1) for i in range(60)]
    whole = d.references(frame(spark, rows))["en"]
    monkeypatch.setattr(d, "COUNTED", 50)
    parts = d.references(frame(spark, rows))["en"]
    assert whole[1] == parts[1] and (whole[0] == parts[0]).all() and (whole[2] == parts[2]).all()
