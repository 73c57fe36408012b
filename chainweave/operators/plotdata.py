"""Data behind the dotplots, tracks and karyograms (drawing is left to the user's tool)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainweave.session import materialise

from chainweave.operators.alignments import orient

KARYOGRAM_WIDTH = 500_000


def reference_order(df: DataFrame, keep: int | None = None) -> DataFrame:
    """Target contigs by largest end, with their offset on a joint axis (contigs in name order on the axis)."""
    ends = df.groupBy("tname").agg(F.max("tend").alias("extent"))
    if keep is not None:
        ends = ends.orderBy(F.col("extent").desc(), "tname").limit(keep)
    # one row per contig, far fewer than alignments
    by_size = Window.orderBy(F.col("extent").desc(), "tname")
    by_name = Window.orderBy("tname").rowsBetween(Window.unboundedPreceding, -1)
    return ends.select(
        "tname", "extent", F.row_number().over(by_size).alias("ref_rank"),
        F.coalesce(F.sum("extent").over(by_name), F.lit(0)).alias("offset"),
    )


def dotplot_rows(
    df: DataFrame, min_align: int = 0, min_query: int = 0, min_span: int = 0, keep: int | None = None, on_target: bool = False
) -> DataFrame:
    """Alignments of a dotplot: filtered, put on the joint reference axis, with mean identity per query.

    Length filters come twice around the alignment filter, as a query may fall below its sum afterwards. With
    ``on_target`` the mean counts only alignments to the contig a query aligns to most.
    """
    kept = orient(df)
    if keep is not None:
        kept = kept.join(reference_order(df, keep).select("tname"), "tname", "left_semi")

    def long_queries(rows: DataFrame) -> DataFrame:
        sums = rows.groupBy("qname").agg(F.sum("alen").alias("_sum")).where(F.col("_sum") > min_query)
        return rows.join(sums.select("qname"), "qname", "left_semi")

    kept = long_queries(long_queries(kept).where(F.col("alen") > min_align))
    axis = reference_order(kept).select("tname", "ref_rank", "offset")
    identity = F.col("nmatch") / F.col("alen")
    per_pair = kept.groupBy("qname", "tname").agg(
        F.sum("alen").alias("_len"), F.sum(identity).alias("_id"), F.count("*").alias("_n")
    )
    main = per_pair.join(axis.select("tname", "ref_rank"), "tname").groupBy("qname").agg(
        F.max_by("tname", F.struct("_len", -F.col("ref_rank"))).alias("main_target"),
        F.sum("_id").alias("_id"), F.sum("_n").alias("_n"),
    )
    if on_target:
        target = per_pair.select("qname", F.col("tname").alias("main_target"), F.col("_id").alias("_tid"), F.col("_n").alias("_tn"))
        main = main.join(target, ["qname", "main_target"]).select("qname", "main_target", F.col("_tid").alias("_id"), F.col("_tn").alias("_n"))
    mean = F.col("_id") / F.col("_n")
    ratio = F.try_divide(F.abs(F.col("tend") - F.col("tstart")), F.abs(F.col("qe") - F.col("qs")))
    return (
        kept.join(axis, "tname").join(main, "qname")
        .where((F.abs(F.col("tend") - F.col("tstart")) > min_span) & ratio.between(0.5, 2))
        .select(
            "qname", "tname", "strand", "qs", "qe", "tstart", "tend", "alen",
            (F.col("tstart") + F.col("offset")).alias("axis_start"), (F.col("tend") + F.col("offset")).alias("axis_end"),
            "ref_rank", "main_target", identity.alias("identity"),
            (F.when(F.col("tname") == F.col("main_target"), mean) if on_target else mean).alias("mean_identity"),
        )
    )


def exact_median(values: DataFrame, column: str, ranges: int = 4096) -> float | None:
    """The median of an integer column, nulls aside: counts per range, then the range that holds the middle rank again in ranges.

    A round counts in every task and sends at most ``ranges`` counts on; four rounds are enough for any length. No task sees the whole column in order.
    """
    some = values.where(F.col(column).isNotNull())
    n, least, most = some.agg(F.count("*"), F.min(column), F.max(column)).first()
    if not n:
        return None

    def at(rank: int) -> int:
        lo, hi = least, most
        while lo < hi:
            width = -(-(hi - lo + 1) // ranges)
            inside = some.where(F.col(column).between(lo, hi)).groupBy(F.expr(f"({column} - {lo}L) div {width}").alias("r")).count()
            for r, count in sorted(map(tuple, inside.collect())):
                if rank < count:
                    lo, hi = lo + r * width, min(hi, lo + (r + 1) * width - 1)
                    break
                rank -= count
        return lo

    low, high = (n - 1) // 2, n // 2
    first = at(low)
    return (first + (first if low == high else at(high))) / 2


def window_summary(windows: DataFrame) -> DataFrame:
    """Number and size range of a window list."""
    sized = materialise(windows.select((F.col("end") - F.col("start")).cast("long").alias("size")))
    return sized.agg(
        F.count("*").alias("n"), F.min("size").alias("smallest"), F.max("size").alias("largest"),
        F.lit(exact_median(sized, "size")).cast("double").alias("median"), F.avg("size").alias("mean"),
    )


def karyogram_spans(windows: DataFrame, width: int = KARYOGRAM_WIDTH) -> DataFrame:
    """Windows widened evenly to a visible width."""
    size = F.col("end") - F.col("start") + 1
    more = F.greatest(F.lit(0), width - size) / 2
    return windows.withColumns({"shown_start": F.col("start") - more, "shown_end": F.col("end") + more})


def segments(block: DataFrame) -> DataFrame:
    """Blocks of a grid as labelled stretches of one axis: ``(region_id, axis, idx, from_pos, to_pos)``."""
    w = Window.partitionBy("region_id", "axis").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("length").over(w)
    return block.select("region_id", "axis", "idx", (end - F.col("length")).alias("from_pos"), end.alias("to_pos"))


def mutated_cells(cells: DataFrame, states: DataFrame) -> DataFrame:
    """Cells of a mutated grid: each block of a state takes its cells along, with their sign turned if inverted."""
    placed = states.select("region_id", F.posexplode("idx").alias("_k", "_b"))
    return placed.join(
        cells.withColumnRenamed("x", "_x"), (placed.region_id == cells.region_id) & (F.abs("_b") == F.col("_x"))
    ).select(placed.region_id, (F.col("_k") + 1).cast("long").alias("x"), "y", (F.signum("_b").cast("long") * F.col("z")).alias("z"))
