import random

import pytest
from pyspark.sql import functions as F

from chainweave.config import GridLimits
from chainweave.operators import grid as g
from chainweave.plans import regions as rg

ALN = "region_id long, tstart long, tend long, qs long, qe long"


def random_alignments(seed, regions=6, n=4):
    rng = random.Random(seed)
    rows = []
    for r in range(regions):
        for _ in range(n):
            t, q, size = rng.randrange(0, 20), rng.randrange(0, 20), rng.randrange(1, 9)
            rows.append((r, t, t + size, *((q, q + size) if rng.random() < 0.6 else (q + size, q))))
    return rows


def naive_lines(alns):
    lines = {("x", v) for _, a, b, _, _ in alns for v in (a, b)} | {("y", v) for _, _, _, a, b in alns for v in (a, b)}
    while True:
        new = set()
        for axis, pos in lines:
            for _, ts, te, qs, qe in alns:
                m = 1 if qe > qs else -1
                if axis == "x" and ts < pos < te:
                    new.add(("y", qs + m * (pos - ts)))
                if axis == "y" and min(qs, qe) < pos < max(qs, qe):
                    new.add(("x", ts + m * (pos - qs)))
        if new <= lines:
            return lines
        lines |= new


def naive_cells(alns, lines):
    xs, ys = (sorted(p for a, p in lines if a == axis) for axis in "xy")
    cells = set()
    for _, ts, te, qs, qe in alns:
        m = 1 if qe > qs else -1
        x, y = ts, qs
        while x < te:
            i = xs.index(x)
            dx = xs[i + 1] - x
            j = ys.index(y) if m == 1 else ys.index(y) - 1
            assert ys[j + 1] - ys[j] == dx
            cells.add((i + 1, j + 1, m * dx))
            x, y = x + dx, y + m * dx
    return cells


def test_gridlines_and_cells_equal_a_walk(spark):
    rows = random_alignments(1)
    df = spark.createDataFrame(rows, ALN)
    lines = g.gridlines(df)
    cells = g.rasterise(df, g.blocks(lines)).distinct()
    got_lines = [tuple(r) for r in lines.collect()]
    got_cells = [tuple(r) for r in cells.collect()]
    for r in {row[0] for row in rows}:
        mine = [row for row in rows if row[0] == r]
        want = naive_lines(mine)
        assert {(a, p) for k, a, p in got_lines if k == r} == want
        assert {(x, y, z) for k, x, y, z in got_cells if k == r} == naive_cells(mine, want)


def test_zero_line_appears_where_nothing_lands(spark):
    lone = spark.createDataFrame([(1, 5, 9, 3, 7)], ALN)
    assert {("x", 0), ("y", 0)} <= {(r.axis, r.pos) for r in g.gridlines(lone, zero_line=True).collect()}
    assert g.gridlines(lone).where("pos = 0").isEmpty()


def test_conflicting_cell_becomes_zero(spark):
    df = spark.createDataFrame([(1, 1, 1, 5), (1, 1, 1, -5), (1, 2, 1, 4), (1, 2, 1, 4)], "region_id long, x long, y long, z long")
    assert sorted(map(tuple, g.resolve_conflicts(df).collect())) == [(1, 1, 1, 0), (1, 2, 1, 4)]


def test_opportunities_golden(spark):
    df = spark.createDataFrame([(1, 1, 1, 5), (1, 3, 1, 5), (1, 4, 1, -5)], "region_id long, x long, y long, z long")
    got = sorted(tuple(r)[1:] for r in g.opportunities(df).collect())
    assert got == [(1, 3, "del"), (1, 3, "dup"), (1, 4, "inv")]


def test_flip_twice_is_the_same_grid(spark):
    rng = random.Random(4)
    rows = [(1, x, y, -10) for x in range(1, 9) for y in range(1, 9) if rng.random() < 0.4]
    df = spark.createDataFrame(rows, "region_id long, x long, y long, z long")
    blocks = spark.createDataFrame([(1, a, i, 10) for a in "xy" for i in range(1, 9)], "region_id long, axis string, idx long, length long")
    vote = g.frame_vote(df, g.dims(blocks))
    assert vote.first().flip
    back = g.flip_where_voted(g.flip_where_voted(df, vote), vote)
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_large_grids_are_coarsened_until_they_fit(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(40):
        t, q = rng.randrange(0, 45_000), rng.randrange(0, 45_000)
        size = rng.randrange(300, 4000)
        rows.append((1, "y", q, q + size, rng.choice("+-"), "x", t, t + size, size, size))
    alns = spark.createDataFrame(
        rows, "region_id long, qname string, qstart long, qend long, strand string, tname string, tstart long, tend long, nmatch long, alen long"
    )
    regions = spark.createDataFrame([(1, "x", 0, 50_000), (2, "x", 0, 50_000)], "region_id long, seqname string, start long, end long")
    limits = GridLimits(max_alignments=30, max_lines=60)
    status, lines, _ = rg.adaptive_grids(alns, rg.region_parameters(regions), limits)
    by_region = {r.region_id: r for r in status.collect()}
    assert by_region[2].status == "empty"
    if by_region[1].status == "gridded":
        assert by_region[1].step > 100 and lines.where("region_id = 1").count() <= 60


def test_coarser_golden(spark):
    from chainweave.functions.scalars import coarser

    df = spark.createDataFrame([(100,), (1000,), (4000,), (8000,)], "s long")
    assert [r[0] for r in df.select(coarser(F.col("s"))).collect()] == [200, 2000, 8000, 10_000]


@pytest.mark.parametrize("rounds,alignments,lines", ((32, 500, 5000), (1, 500, 5000), (32, 3, 5000), (32, 500, 10)))
def test_gridlines_found_in_a_row_or_by_joins_are_the_same(spark, monkeypatch, rounds, alignments, lines):
    """Small regions need no join; whatever is too large for a row goes on by joins."""
    monkeypatch.setattr(g, "ROUNDS", rounds)
    monkeypatch.setattr(g, "MANY_ALIGNMENTS", alignments)
    monkeypatch.setattr(g, "MANY_LINES", lines)
    if (rounds, alignments, lines) == (32, 500, 5000):
        monkeypatch.setattr(g, "_project", None)
    rows = random_alignments(2)
    got = [tuple(x) for x in g.gridlines(spark.createDataFrame(rows, ALN)).collect()]
    want = {(r, a, p) for r in {row[0] for row in rows} for a, p in naive_lines([row for row in rows if row[0] == r])}
    assert set(got) == want and len(got) == len(want)


def test_a_region_with_too_many_lines_is_not_carried_on(spark):
    rows = random_alignments(2)
    got = g.gridlines(spark.createDataFrame(rows, ALN), limit=6).groupBy("region_id").count().collect()
    full = g.gridlines(spark.createDataFrame(rows, ALN)).groupBy("region_id").count().collect()
    want = {r["region_id"]: r["count"] for r in full}
    assert all(r["count"] == want[r["region_id"]] or 6 < r["count"] < want[r["region_id"]] for r in got)
