import math
from collections import defaultdict

import numpy as np
import pytest

from chainweave.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, bucket long"


def table(spark, n=1500, dim=24):
    r = np.random.default_rng(2)
    centres = r.normal(size=(40, dim))
    vectors = (centres[r.integers(0, 40, n)] + 0.6 * r.normal(size=(n, dim))) * r.uniform(0.5, 2, (n, 1))
    vectors[: n // 3] = vectors[5]  # a third are equal
    rows = [(i, [float(np.float32(x)) for x in v], 0, i) for i, v in enumerate(vectors)]
    rows += [(20_000, None, 1, 1), (20_020, [], 1, 1), (20_040, [0.0] * dim, 1, 1), (20_060, [math.nan] + [1.0] * (dim - 1), 1, 1)]
    rows += [(20_080, [None] + [1.0] * (dim - 1), 1, 1), (20_100, [math.inf] * dim, 1, 1), (20_120, [1.0, 2.0], 1, 1), (20_121, [2.0, 1.0], 1, 1), (None, [1.0] * dim, 1, 1)]
    return rows, spark.createDataFrame(rows + rows[100:102], SCHEMA).repartition(4)


@pytest.mark.parametrize("block", (4096, 100))
def test_recall_and_order(spark, monkeypatch, block):
    monkeypatch.setattr(ann, "BLOCK", block)
    rows, df = table(spark)
    got = defaultdict(list)
    for r in ann.nearest(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    fine = {i: np.array(v, float) for i, v, *_ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    hits = total = 0
    for q in (i for i in fine if i % 20 == 0):
        near = sorted((-float((fine[q] * fine[i]).sum()), i) for i in fine if i != q and len(fine[i]) == len(fine[q]))[:20]
        own = got.pop(q)
        assert [r for r, _, _ in own] == list(range(1, len(own) + 1)) and len(own) == len(near)
        assert own == [(k, i, s) for k, (_, i, s) in enumerate(sorted((-s, i, s) for _, i, s in own), 1)]
        for _, i, s in own:
            assert abs(s - float((fine[q] * fine[i]).sum())) < 1e-12
        hits += len({i for _, i in near} & {i for _, i, _ in own})
        total += len(near)
    assert not got and hits / total >= 0.95


def test_rotation_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 6))
    near = ann.axes(x, 2)
    assert near.shape == (5, 16) and np.allclose((near[:, :8] ** 2).sum(1), (x**2).sum(1))


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert ann.nearest(df, df).collect() == []
    one = spark.createDataFrame([(0, [1.0, 0.0], 1, 1)], SCHEMA)
    assert ann.nearest(one, one).collect() == []


def test_ties_go_to_the_smaller_id(spark):
    """Three hundred unlike vectors with one inner product: the twenty smallest ids are the nearest."""
    r = np.random.default_rng(3)
    rows = [(0, [8.0] + [0.0] * 15, 0, 0)] + [(i, [1.0, *r.integers(-4, 5, 15).astype(float).tolist()], 0, 0) for i in range(1, 301)]
    got = ann.nearest(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(rows[:1], SCHEMA), target=1.0, tables=8)
    found = [x.vec_id for x in got.orderBy("rank").collect()]
    everywhere = [x.vec_id for x in ann.nearest(spark.createDataFrame(rows[:25], SCHEMA), spark.createDataFrame(rows[:1], SCHEMA)).orderBy("rank").collect()]
    assert found == sorted(found) and len(found) == 20 and everywhere == list(range(1, 21))
