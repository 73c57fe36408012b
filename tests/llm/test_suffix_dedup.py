import random
from collections import Counter

import pytest
from fixtures import documents, frame, prose

from chainweave.llm import suffix_dedup as s


def test_suffix_array_is_sorted():
    r = random.Random(1)
    for k in range(600):
        text = [r.randint(1, r.choice((1, 2, 5))) for _ in range(r.randint(0, 30))] * r.choice((1, 1, 4)) + [0]
        assert s.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:]), k


def brute(rows):
    """Documents by id (null first), then hash of the text; of each: bytes, removed, spans, what is kept."""
    import xxhash

    def place(r):
        h = xxhash.xxh64_intdigest(r[1].encode(), 42) if r[1] is not None else 42
        return (r[0] is not None, r[0] or 0, h - (1 << 64) if h >> 63 else h)

    seen, out = set(), {}
    for r in sorted({(r[0], r[1]) for r in rows}, key=place):
        raw = (r[1] or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - s.LENGTH + 1):
            w = raw[k : k + s.LENGTH]
            if w in seen:
                gone[k : k + s.LENGTH] = b"\1" * s.LENGTH
            seen.add(w)
        out[r] = (len(raw), sum(gone), (b"\0" + bytes(gone)).count(b"\0\1"), bytes(x for x, g in zip(raw, gone) if not g))
    return out


def planted():
    passage = prose(77, 60)
    rows = documents() + [(600 + i, prose(300 + i, 30) + passage + prose(400 + i % 5, 40), "en", "s", 1) for i in range(30)]
    return rows + [(700, "ab" * 400 + passage[20:] + "é" * 120, "en", "s", 1), (701, "z" + "é" * 130 + passage[:130], "en", "s", 1)]


@pytest.mark.parametrize("crowd, few, chunk", ((2000, 1_000_000, 6_000_000), (3, 0, 700)))
def test_against_brute_force(spark, monkeypatch, crowd, few, chunk):
    for name, value in (("CROWD", crowd), ("FEW_PLACES", few), ("BITMAP_BITS", 26 if few else 8), ("CHUNK_BYTES", chunk), ("ARRAY_BYTES", 2000)):
        monkeypatch.setattr(s, name, value)
    rows = planted()
    got = s.remove_repeats(frame(spark, rows, extra=("id", "tie", "raw", "a", "h"))).collect()
    want = brute(rows)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == Counter((r[0], *want[r[0], r[1]]) for r in rows)
    assert sum(r.n_removed for r in got) > 9000


def test_a_text_with_more_places_than_fit(spark, monkeypatch):
    monkeypatch.setattr(s, "CHUNK_BYTES", 700)
    monkeypatch.setattr(s, "PLACE_BITS", 12)
    long = prose(88, 3000)
    rows = [(1, long, "en", "s", 1), (2, prose(89, 40) + long[9000:9500] + prose(90, 40), "en", "s", 1), (3, prose(91, 2500) + long[6000:6400], "en", "s", 1)]
    assert len(long) > 3 << s.PLACE_BITS
    got = s.remove_repeats(frame(spark, rows)).collect()
    want = brute(rows)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == Counter((r[0], *want[r[0], r[1]]) for r in rows)
    assert sum(r.n_removed for r in got) >= 900


def test_empty(spark):
    assert s.remove_repeats(frame(spark, [])).collect() == []
    short = s.remove_repeats(frame(spark, [(1, "x" * 99, "en", "s", 1), (2, "x" * 99, "en", "s", 1), (3, None, None, None, None)])).collect()
    assert all(r.n_removed == 0 for r in short)


def test_windows_side_by_side_are_one_span(spark):
    passage = prose(55, 60)[:180].encode()
    rows = [(7, i, 0, 10 * i, passage + bytes([65 + i])) for i in range(3)]
    reps = spark.createDataFrame(rows, "h long, id long, tie long, lo long, owned binary")
    assert sorted(map(tuple, s._contested_spans(reps).collect())) == [(1, 0, 10, 190), (2, 0, 20, 200)]
