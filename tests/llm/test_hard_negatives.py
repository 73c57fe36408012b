import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainweave.llm import hard_negatives, queries

SCHEMA = "vec_id long, embedding array<double>, label int, n int, block int"


def table(spark, n=1200, dim=12, labels=4):
    r = np.random.default_rng(4)
    centres = r.normal(size=(25, dim))
    vectors = centres[r.integers(0, 25, n)] + 0.1 * r.normal(size=(n, dim))
    vectors[: n // 3] = vectors[3]  # a third are equal, and of one label
    label = r.integers(0, labels, n)
    label[: n // 4] = 1
    rows = [(i, [float(x) for x in v], int(a), i, i) for i, (v, a) in enumerate(zip(vectors, label))]
    odd = [(5000, None, 1, 1, 1), (5100, [], 1, 1, 1), (5200, [0.0] * dim, 1, 1, 1), (5300, [math.nan] + [1.0] * (dim - 1), 1, 1, 1)]
    odd += [(5400, [1.0] * dim, None, 1, 1), (5500, [None] + [1.0] * (dim - 1), 1, 1, 1), (5600, [math.inf] * dim, 1, 1, 1)]
    odd += [(5700, [1.0, 2.0], 1, 1, 1), (5701, [1.0, 2.5], 1, 1, 1), (5702, [0.9, 2.0], 2, 1, 1), (None, [1.0] * dim, 1, 1, 1), (100, [9.0] * dim, 2, 1, 1)]
    return rows + odd, spark.createDataFrame(rows + odd + rows[100:103], SCHEMA).repartition(5)


def brute(rows, relabel=lambda i, a: a):
    fine = {(i, relabel(i, a), tuple(math.floor(256 * x) for x in v)) for i, v, a, *_ in rows
            if i is not None and a is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, a, v in (x for x in fine if x[0] % 100 == 0):
        near = sorted((-sum(x * y for x, y in zip(v, w)), j, b) for j, b, w in fine if j != i and len(w) == len(v))
        for p, j, _ in [x for x in near if x[2] == a][:5]:
            found = [x for x in near if x[2] != a and 80 * -p <= 100 * -x[0] <= 100 * -p][:5]
            out += [(i, j, k, m, -p, -s) for k, (s, m, _) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("block,tree,slice_", ((4096, 256, 16), (100, 4, 2)))
def test_against_brute_force(spark, monkeypatch, tmp_path, block, tree, slice_):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "TREE", tree)
    monkeypatch.setattr(hard_negatives, "SLICE", slice_)
    monkeypatch.setattr(hard_negatives.forest, "__defaults__", (tree,))
    rows, df = table(spark)
    columns = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    got = hard_negatives.mine(df, F.col("vec_id") % 100 == 0).select(*columns)
    assert sorted(map(tuple, got.collect())) == brute(rows)
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.QUERIES["op12_hard_negatives"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i, a: (a + 1) % 10 if i % 7 == 0 else a)


def test_bounds_hold_and_spare_products():
    r = np.random.default_rng(7)
    anchors = (r.normal(size=8) * 200 + r.normal(size=(60, 8)) * 2).astype(np.int64)
    x = (r.normal(size=(500, 8)) * 100).astype(np.int64)
    parent, edge, levels = hard_negatives.spanning_tree(anchors)
    assert sum(map(len, levels)) == 60 and (parent < 0).sum() == 1
    bounds, scores = hard_negatives.Bounds(anchors, parent, edge, x), anchors @ x.T
    high = np.quantile(scores, 0.99)
    for of in levels:
        bounds.inherit(of)
        assert (bounds.low[of] <= scores[of]).all() and (bounds.high[of] >= scores[of]).all()
        bounds.rescore(of, bounds.high[of] >= high)
    found = bounds.known & (bounds.score >= high)
    assert (found == (scores >= high)).all() and bounds.rescored < scores.size / 4


def test_large_scores():
    a = np.array([[2**31, 1, -1]])
    assert hard_negatives.exact(a, np.array([[2**30, 3, 5]])).tolist() == [[2**61 - 2]]
    with pytest.raises(ArithmeticError):
        hard_negatives.exact(a, np.array([[2**33, 0, 0]]))


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert hard_negatives.mine(df, F.col("vec_id") % 100 == 0).collect() == []
    one = spark.createDataFrame([(0, [1.0], 1, 1, 1)], SCHEMA)
    assert hard_negatives.mine(one, F.col("vec_id") % 100 == 0).collect() == []
