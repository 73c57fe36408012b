"""Every registered query at the smallest scale, against its SQL text where there is one."""

import glob
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracle import compare

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(os.path.join(SF_DIR, "*.parquet")):
        c.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c


@pytest.mark.parametrize("name", list(queries()))
def test_query_matches_oracle(spark, con, name):
    ok, note = compare(spark, con, name, SF_DIR, queries(), oracle_sql())
    assert ok, note


def test_entry_has_rows(spark):
    assert entry(spark).columns == ["chr", "qname", "start", "end"]
