import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from fixtures import documents, frame

from chainweave.llm import golay_simhash as g
from chainweave.llm.components import components


def test_segments_two_bits_apart_share_a_codeword():
    r = np.random.default_rng(1)
    x = r.integers(0, 1 << 23, 3000)
    for bits in (0, 1, 2):
        y = x.copy()
        for row in range(len(y)):
            for b in r.choice(23, bits, replace=False):
                y[row] ^= 1 << int(b)
        a, b = g.codeword_indices(x), g.codeword_indices(y)
        assert all(set(p[p >= 0]) & set(q[q >= 0]) for p, q in zip(a, b))


def brute_print(text, width=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("bucket", (32, 0))
def test_near_duplicates_against_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(g, "BUCKET", bucket)
    r = random.Random(2)
    rows = documents() + [(500 + k, f"{'a b c d e f g h ' * 20} {r.random() if k % 2 else 'same'}", "en", "s", 1) for k in range(30)]
    got = g.near_duplicates(frame(spark, rows, extra=("fp", "key", "z"))).collect()
    prints = [brute_print(t) for _, t, *_ in rows]
    comp = {}
    for i in range(len(rows)):
        if i in comp:
            continue
        todo, seen = [i], {i}
        while todo:
            j = todo.pop()
            more = {k for k in range(len(rows)) if k not in seen and (prints[j] ^ prints[k]).bit_count() <= 2}
            seen |= more
            todo += more
        least = min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)
        comp |= dict.fromkeys(seen, least)
    want = Counter((rows[i][0], f"{prints[i]:016x}", comp[i]) for i in range(len(rows)))
    assert Counter(map(tuple, got)) == want


def test_links_find_every_close_pair(spark):
    r = random.Random(3)
    prints = [r.getrandbits(64) for _ in range(60)]
    prints += [p ^ sum(1 << b for b in r.sample(range(64), k)) for p in prints for k in (1, 2, 3)]
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in set(prints)]
    got = {frozenset(x) for x in g.links(spark.createDataFrame(signed, "fp long")).collect()}
    assert got == {frozenset((a, b)) for (a,) in signed for (b,) in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}


def test_components_of_chains_and_stars(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(200)] + [(1000, k) for k in range(1001, 1300)] + [(5000, 5001), (7, 7)]
    names = list(range(6000))
    r.shuffle(names)
    got = dict(components(spark.createDataFrame([(names[a], names[b]) for a, b in edges], "a long, b long")).collect())
    want = {}
    for group in (range(201), range(1000, 1300), (5000, 5001)):
        least = min(names[k] for k in group)
        want |= {names[k]: least for k in group}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("few", (500_000, 0))
def test_deduplicate_keeps_one_of_each_group(spark, monkeypatch, few):
    monkeypatch.setattr(g, "FEW_TEXTS", few)
    rows = documents()
    got = g.deduplicate(frame(spark, rows, extra=("did", "node", "root"))).collect()
    ids = Counter(r.doc_id for r in got)
    # 31 copies 30 and 32 nearly does; 40, 41 and 42 have no word; 43 is there twice; 49 differs from itself in case only
    assert 30 in ids and 31 not in ids and 32 not in ids and ids[43] == 1 and ids[49] == 1 and ids[None] == 1
    assert 40 in ids and not {41, 42} & set(ids) and {0, 33, 44, 45} <= set(ids)
    sets = {r.doc_id: g.shingle_set((r.text or "").encode()) for r in got}
    kept = list(sets)
    assert not any(g.jaccard(sets[a], sets[b]) >= 0.8 for i, a in enumerate(kept) for b in kept[:i])
    assert g.deduplicate(frame(spark, [])).collect() == []


def similar_pairs(seed=6, n=40):
    """Texts of distinct words and their copies: appended, truncated, and with scattered edits, all at a similarity of 0.8 to 0.9."""
    r = random.Random(seed)
    rows = []
    for k in range(n):
        w = [f"w{r.getrandbits(40):x}" for _ in range(300)]
        more = [f"w{r.getrandbits(40):x}" for _ in range(60)]
        scattered = w.copy()
        for at in range(10, 300, 50):
            scattered[at] = f"w{r.getrandbits(40):x}"
        rows.append([" ".join(x) for x in (w, w + more, w[:250], scattered)])
    return rows


@pytest.mark.parametrize("bucket", (32, 2))
def test_deduplicate_finds_every_similar_pair(spark, monkeypatch, bucket):
    monkeypatch.setattr(g, "BUCKET", bucket)
    rows = [(10 * k + i, x, "en", "s", 1) for k, some in enumerate(similar_pairs()) for i, x in enumerate((some[0], some[1 + k % 3]))]
    for k in range(0, len(rows), 2):
        assert 0.8 <= g.jaccard(*(g.shingle_set(r[1].encode()) for r in rows[k : k + 2])) < 0.93
    assert sorted(r.doc_id for r in g.deduplicate(frame(spark, rows)).collect()) == [10 * k for k in range(40)]


@pytest.mark.parametrize("bucket", (32, 2))
def test_deduplicate_loses_no_pair_with_an_unlike_hub(spark, monkeypatch, bucket):
    """All texts have the same words, so the same fingerprints; only some are in nearly the same order."""
    monkeypatch.setattr(g, "BUCKET", bucket)
    r = random.Random(7)
    words, rows = [f"v{k}" for k in range(150)], []
    for k in range(12):
        r.shuffle(words)
        swapped = words.copy()
        swapped[70], swapped[71] = swapped[71], swapped[70]
        rows += [(100 * k, " ".join(words), "en", "s", 1), (100 * k + 1, " ".join(swapped), "en", "s", 1), (100 * k + 2, " ".join(words[:-8]), "en", "s", 1)]
    assert sorted(x.doc_id for x in g.deduplicate(frame(spark, rows)).collect()) == [100 * k for k in range(12)]
