import os

from chainweave import session


def test_a_scope_drops_its_tables(spark):
    kept = session.materialise(spark.range(3))
    with session.scratch(spark):
        inside = session.materialise(spark.range(5))
        with session.scratch(spark):
            inner = session.materialise(spark.range(7))
            assert inner.count() == 7
        assert inside.count() == 5
        paths = ["/" + f.removeprefix("file:").lstrip("/") for f in inside.inputFiles()]
        assert all(map(os.path.exists, paths))
    assert kept.count() == 3 and paths and not any(os.path.exists(p) for p in paths)
