"""Run registered queries next to their DuckDB text and compare names, row counts and sorted values.

    python check_oracle.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import glob
import os
import sys
import time

import duckdb
import pandas as pd

from chainweave.session import local_session


def normalise(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf[sorted(pdf.columns)].copy()
    for c in pdf.columns:
        if pdf[c].dtype.kind == "f":
            pdf[c] = pdf[c].round(6) + 0.0
    return pdf.sort_values(list(pdf.columns), na_position="first").reset_index(drop=True)


def compare(spark, con, name: str, sf_dir: str, queries, oracles) -> tuple[bool, str]:
    t0 = time.time()
    got = queries[name](spark, sf_dir).toPandas()
    t1 = time.time()
    if name not in oracles:
        return len(got) > 0, f"rows-only rows={len(got)} spark={t1 - t0:.1f}s"
    want = con.execute(oracles[name]).df()
    t2 = time.time()
    note = f"rows={len(got)}/{len(want)} spark={t1 - t0:.1f}s duckdb={t2 - t1:.1f}s"
    if sorted(got.columns) != sorted(want.columns):
        return False, f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    types = [f"{c}:{got[c].dtype}/{want[c].dtype}" for c in got.columns if got[c].dtype.kind != want[c].dtype.kind]
    a, b = normalise(got), normalise(want)
    if len(a) != len(b):
        return False, note
    for c in a.columns:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            i = (~same).idxmax()
            return False, f"{note} first difference in {c}: {a.loc[i].to_dict()} != {b.loc[i].to_dict()}"
    return True, note + (f" TYPES {types}" if types else "") + (" EMPTY" if not len(a) else "")


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    from chainweave.catalog import ORACLES, QUERIES

    con = duckdb.connect()
    for path in glob.glob(os.path.join(args.sf, "*.parquet")):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in args.names or list(QUERIES):
        try:
            ok, note = compare(spark, con, name, args.sf, QUERIES, ORACLES)
        except Exception as exc:  # report and go on with the next query
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
