"""Domain views over the given tables: each a rule on whole tables, as Spark expressions and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_PAF = {
    "qname": "concat('ctg', cast(l_suppkey % 40 as string))",
    "qstart": "l_orderkey * 1000 + l_partkey * 50",
    "qend": "l_orderkey * 1000 + l_partkey * 50 + cast(l_quantity as bigint) * 1000",
    "strand": "case when l_returnflag = 'R' then '-' else '+' end",
    "tname": "concat('chr', cast(l_partkey % 22 as string))",
    "tstart": "l_orderkey * 1000 + l_linenumber * 10",
    "tend": "l_orderkey * 1000 + l_linenumber * 10 + cast(l_quantity as bigint) * 1000",
    "nmatch": "cast(l_quantity as bigint) * 1000 - cast(round(l_discount * 100) as bigint)",
    "alen": "cast(l_quantity as bigint) * 1000",
}
PAF = "paf as (select " + ", ".join(f"{e} as {n}" for n, e in _PAF.items()) + " from lineitem)"


def paf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments: one per line item, placed by its order, part and supplier."""
    return table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} as {n}" for n, e in _PAF.items()])


# a contig is as long as its last alignment reaches
PAF_LENGTHS = "sized_paf as (select *, max(qend) over (partition by qname) as qlen from paf)"


def paf_with_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paf(spark, sf_dir)
    return rows.join(rows.groupBy("qname").agg(F.max("qend").alias("qlen")), "qname").select(*rows.columns, "qlen")


# one key per pair of target and query contig, so that the spans of a key do not all run together
_SPAN_KEY = "concat(tname, '_', qname)"
SPANS = f'a as (select {_SPAN_KEY} as chr, tstart as "start", tend as "end" from paf)'
SPAN_GENOME = 'genome as (select chr, max("end") as length from a group by chr)'
_RIVAL = {
    "chr": "concat('chr', cast(o_orderkey % 22 as string), '_ctg', cast(o_custkey % 40 as string))",
    "start": "o_orderkey * 1000",
    "end": "o_orderkey * 1000 + {size} + o_custkey % 50 * 100",
}


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target spans of all alignments, by pair of contigs."""
    return paf(spark, sf_dir).selectExpr(f"{_SPAN_KEY} as chr", "tstart as start", "tend as end")


def span_genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(spark, sf_dir).groupBy("chr").agg(F.max("end").alias("length"))


def rivals(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    """A second set of spans, one per order, ``size`` to ``size`` + 4900 long."""
    return table(spark, sf_dir, "orders").selectExpr(*[f"{e.format(size=size)} as {n}" for n, e in _RIVAL.items()])


def rivals_sql(name: str, size: int) -> str:
    return f"{name} as (select " + ", ".join(f'{e.format(size=size)} as "{n}"' for n, e in _RIVAL.items()) + " from orders)"


def genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contig lengths: where the last alignment ends."""
    return paf(spark, sf_dir).groupBy(F.col("tname").alias("chr")).agg(F.max("tend").alias("length"))


GENOME = "genome as (select tname as chr, max(tend) as length from paf group by tname)"

_GRID_PAF = {
    "region_id": "l_orderkey",
    "tstart": "(l_partkey % 24) * 1000",
    "tend": "(l_partkey % 24) * 1000 + (cast(l_quantity as bigint) % 12 + 1) * 1000",
    "qstart": "(l_suppkey % 24) * 1000",
    "qend": "(l_suppkey % 24) * 1000 + (cast(l_quantity as bigint) % 12 + 1) * 1000",
    "strand": "case when l_returnflag = 'R' then '-' else '+' end",
}
GRID_PAF = "gpaf as (select distinct " + ", ".join(f"{e} as {n}" for n, e in _GRID_PAF.items()) + " from lineitem)"


def grid_paf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Square alignments of one region per order, on a 1 kb raster."""
    return table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} as {n}" for n, e in _GRID_PAF.items()]).distinct()


_CELL = {
    "region_id": "cast(floor(event_id / 60) as bigint)",
    "x": "cast(user_id % 12 + 1 as bigint)",
    "y": "cast((event_id * 7 + user_id) % 12 + 1 as bigint)",
    "z": "case when event_type in ('view', 'error') then -1 else 1 end * (100 + 10 * (user_id % 12 + 1))",
}
CELLS = "cells as (select " + ", ".join(f"{e} as {n}" for n, e in _CELL.items()) + " from events)"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw grid cells: sixty consecutive events make one region of 12 x 12 blocks."""
    return table(spark, sf_dir, "events").selectExpr(*[f"{e} as {n}" for n, e in _CELL.items()])
