"""Connected components of an edge table, by hooking to the least neighbour, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainweave.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``a, b``: the root is the least node of the component.

    Each round hooks every node to its least neighbour, jumps twice, and replaces the ends of the edges by what they
    hang on; edges within one node go. All but local minima are hooked, so at least half of the nodes leave in a round.
    A node with very many neighbours is only ever a key of a partial minimum or of a join, never a gathered group.
    Lineage is cut with tables in the shared folder.
    """
    live = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    known = None
    while True:
        both = live.select("a", "b").union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root"))
        step = materialise(_jump(materialise(_jump(hook))))
        known = step if known is None else materialise(_follow(known, step))
        live = materialise(
            _renamed(_renamed(live, step, "a"), step, "b").where("a <> b")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        )
        if live.isEmpty():
            return known


def _jump(step: DataFrame) -> DataFrame:
    return _follow(step, step)


def _follow(known: DataFrame, step: DataFrame) -> DataFrame:
    """Where a root is itself hooked in ``step``, go on to what it hangs on."""
    to = step.select(F.col("node").alias("via"), F.col("root").alias("to"))
    return known.join(to, F.col("root") == F.col("via"), "left").select("node", F.coalesce("to", "root").alias("root"))


def _renamed(edges: DataFrame, step: DataFrame, end: str) -> DataFrame:
    to = step.select(F.col("node").alias("via"), F.col("root").alias("to"))
    other = "b" if end == "a" else "a"
    return edges.join(to, F.col(end) == F.col("via")).select(F.col("to").alias(end), other)
