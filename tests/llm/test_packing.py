import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import documents, frame
from test_records import plain_ids

from chainweave.llm import packing


def test_pieces_come_back(spark):
    rows = documents()
    got = packing.pack_documents(frame(spark, rows, extra=("uid", "size", "bin"))).collect()
    want = Counter()
    for (i, *_), ids in zip(rows, plain_ids([r[1] for r in rows])):
        for k, (at, n) in enumerate(packing.cuts(len(ids))):
            want[i, k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    of = defaultdict(list)
    for r in got:
        of[r.sequence_id].append(r)
    for own in of.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.CAPACITY
    assert len(of) <= sum(r.length for r in got) / packing.CAPACITY * 1.1 + 1


def test_cuts():
    assert packing.cuts(1) == [(0, 1)] and packing.cuts(2048) == [(0, 2048)]
    assert packing.cuts(4096) == [(0, 2048), (2048, 2048)] and packing.cuts(4097) == [(0, 1), (1, 2048), (2049, 2048)]


def test_best_fit_takes_the_tightest_bin():
    bins, offsets, fill = packing.best_fit(np.array([6, 7, 3, 4, 1]), 10)
    assert fill.tolist() == [10, 10, 1] and bins.tolist() == [1, 0, 0, 1, 2] and offsets.tolist() == [0, 0, 7, 6, 0]


@pytest.mark.parametrize("tasks", (1, 30))
def test_rounds_merge_what_tasks_left(spark, monkeypatch, tasks):
    monkeypatch.setattr(packing, "ITEMS_A_TASK", 40)
    sizes = [int(x) for x in np.random.default_rng(3).integers(1, 700, 600)]
    items = spark.createDataFrame(list(enumerate(sizes)), "uid long, size long").repartition(tasks)
    got = packing.pack(items).collect()
    fill = Counter()
    for r in got:
        fill[r.sequence_id] += r.size
    assert len(got) == 600 and max(fill.values()) <= packing.CAPACITY
    assert len(fill) <= -(-sum(sizes) // packing.CAPACITY) + 4


def test_items_that_never_fit_together(spark):
    items = spark.createDataFrame([(i, 1500) for i in range(50)], "uid long, size long").repartition(8)
    assert packing.pack(items).select("sequence_id").distinct().count() == 50


def test_empty(spark):
    assert packing.pack_documents(frame(spark, [])).collect() == []
