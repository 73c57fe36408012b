import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainweave.llm import common, queries, runs
from fixtures import documents, frame


def brute(w):
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
            i = j
    return sorted((s, q, n) for (s, n), q in out.items())


@pytest.mark.parametrize("pairs", (1_000_000, 7))
def test_against_brute_force(monkeypatch, pairs):
    monkeypatch.setattr(runs, "PAIRS", pairs)
    r = random.Random(1)
    for _ in range(250):
        docs = []
        for _ in range(r.randint(1, 6)):
            d = [r.randrange(r.choice([1, 2, 3, 30])) for _ in range(r.choice([0, 1, 5, 8, 20, 60, 200, 400]))]
            for _ in range(r.randint(0, 3) if len(d) > 4 else 0):
                a = r.randrange(len(d))
                p = 1 + r.randrange(max(1, (len(d) - a) // 3))
                for i in range(a, r.randint(a, len(d))):
                    d[i] = d[a + (i - a) % p]
            docs.append(d)
        flat = np.array([x for d in docs for x in d], np.int64)
        doc, start, length, period = runs.find_runs(flat, np.array([len(d) for d in docs]))
        got = [[] for _ in docs]
        for k, *run in zip(doc.tolist(), start.tolist(), period.tolist(), length.tolist()):
            got[k].append(tuple(run))
        assert got == [brute(d) for d in docs]


def test_extensions():
    r = np.random.default_rng(5)
    words = np.concatenate([r.integers(0, 3, 200), np.tile(r.integers(0, 9, 70), 6)])
    ends = np.full(len(words), len(words))
    i, j = (r.integers(0, len(words), 3000) for _ in range(2))
    i, j = i[i != j], j[i != j]
    want = [next((k for k in range(len(words)) if max(a, b) + k >= len(words) or words[a + k] != words[b + k]), 0) for a, b in zip(i, j)]
    assert runs.Extensions(words, ends, np.ones(len(words), bool))(i, j).tolist() == want


@pytest.mark.parametrize("size", (1_000_000, 500))
def test_operator(spark, monkeypatch, size):
    monkeypatch.setattr(common, "SLICE_BYTES", size)
    rows = documents() + [(60, "a b c " * 30 + "end", "en", "s", 0), (60, "a b c " * 30 + "end", "en", "s", 0), (61, "x " * 5 + "y", "en", "s", 0)]
    df = frame(spark, rows, ("runs", "n_words", "start"))
    got = sorted((r.doc_id is not None, r.doc_id, r.n_words, [(x.start, x.period, x.length) for x in r.runs]) for r in runs.with_runs(df, keep=("lang",)).collect())
    texts = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    assert got == sorted((i is not None, i, len(w), brute(w)) for i, w in texts)
    left = sorted((r.doc_id is not None, r.doc_id, r.text) for r in runs.collapse_runs(df).collect())
    want = []
    for i, w in texts:
        gone = {k for s, q, n in brute(w) for k in range(s + q, s + n)}
        want.append((i is not None, i, b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    assert left == sorted(want) and (True, 60, "a b c end") in left and runs.with_runs(df.limit(0)).collect() == []


def test_query(spark, tmp_path):
    rows = [r for r in documents() if r[0] is not None] + [(i, r[1], "en", "s", 0) for i, r in enumerate(documents()[:20], 100)] * 2
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        h, n = zlib.crc32(str(i).encode()), len(w)
        if h % 10 == 0 and n:
            a, p = h // 10 % n, 1 + (n - h // 10 % n) // (3 + h // 10 % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        found = brute(w)
        best = min(found, key=lambda x: (-x[2] / x[1], x[0], x[1]), default=None)
        shown = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
        gone = {k for s, q, n in found for k in range(s + q, s + n)}
        lines = "".join(f"{s},{n},{q}\n" for s, q, n in found)
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(found), *shown, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in queries.QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and any(r[1] for r in got)


def test_hot_words(spark):
    """One word everywhere: a single run however long the text is, and bounded work for it."""
    df = spark.range(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), 60_000).alias("text"))
    assert [(x.start, x.length, x.period) for x in runs.with_runs(df).first().runs] == [(0, 60_000, 1)]
