"""Call post-processing: steps of mutation chains, the source that wins an interval, and the ordered fold."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainweave.functions.scalars import simple_mutation
from chainweave.operators.intervals import cluster
from chainweave.operators.rangejoin import overlap_join
from chainweave.session import materialise

SOURCE = ["src_start", "src_end"]


def reference_regions(results: DataFrame, threshold: float = 98.0) -> DataFrame:
    """Regions without a trusted call: they compete as sources of their own."""
    return results.where(F.col("res_max") < threshold).select(
        F.col("seqname").alias("chr"), F.col("start").alias("src_start"), F.col("end").alias("src_end")
    )


def call_steps(results: DataFrame, threshold: float = 98.0) -> DataFrame:
    """One row per step of every trusted chain: chr, start, end, step, name and the source region.

    A column ``mut_steps`` holds the places of all steps, as an array of start and end or as the text of a result file; without it those
    of the first three are taken from the flat columns.
    """
    called = results.where((F.col("res_max") > threshold) & (F.col("mut_max") != "ref"))
    if "mut_steps" in results.columns and dict(results.dtypes)["mut_steps"] == "string":
        place = lambda p, k: F.try_to_number(F.split_part(p, F.lit("-"), F.lit(k)), F.lit("9999999999999999")).cast("long")
        places = F.transform(F.split("mut_steps", "\\+"), lambda p: F.struct(place(p, 1).alias("start"), place(p, 2).alias("end")))
    elif "mut_steps" in results.columns:
        places = F.col("mut_steps")
    else:
        places = F.array(*[F.struct(F.col(f"mut{n}_start").alias("start"), F.col(f"mut{n}_end").alias("end")) for n in (1, 2, 3)])
    steps = called.select(
        F.col("seqname").alias("chr"), F.col("start").alias("src_start"), F.col("end").alias("src_end"),
        places.alias("_places"), F.posexplode(F.split("mut_max", "\\+")).alias("_i", "name"),
    )
    return (
        steps.withColumn("_at", F.get("_places", "_i"))
        .where("_at.start is not null and _at.end is not null and _at.end > _at.start")
        .select("chr", F.col("_at.start").alias("start"), F.col("_at.end").alias("end"), (F.col("_i") + 1).alias("step"), "name", *SOURCE)
    )


def with_islands(steps: DataFrame) -> DataFrame:
    """Add ``island``, the start of the merged interval that a step is a member of."""
    return cluster(steps).withColumnRenamed("cluster", "island")


def competing_sources(steps: DataFrame, references: DataFrame) -> DataFrame:
    """Merged step intervals with every source that claims them: ``(chr, start, end, src_start, src_end, ref)``.

    Own sources are those of the member steps; a reference region joins in if it overlaps the merged interval and
    lies inside one of its own sources. Long form: one row per source, never a collected list.
    """
    members = (steps if "island" in steps.columns else with_islands(steps)).select("chr", "island", "end", *SOURCE)
    merged = members.groupBy("chr", "island").agg(F.max("end").alias("end"))
    sources = members.select("chr", "island", *SOURCE).distinct()
    own = sources.join(merged, ["chr", "island"]).select("chr", F.col("island").alias("start"), "end", *SOURCE)
    own = materialise(own)  # an overlap join reads its inputs twice
    refs = references.select("chr", F.col("src_start").alias("_rs"), F.col("src_end").alias("_re")).distinct()
    inside = (F.col("_rs") >= F.col("src_start")) & (F.col("_re") <= F.col("src_end"))
    joining = overlap_join(own, refs, ["chr"], ("start", "end"), ("_rs", "_re"), inside).select(
        "chr", "start", "end", F.col("_rs").alias("src_start"), F.col("_re").alias("src_end")
    )
    return own.withColumn("ref", F.lit(False)).unionByName(joining.distinct().withColumn("ref", F.lit(True)))


def winning_sources(competing: DataFrame) -> DataFrame:
    """Per merged interval the shortest source that covers it whole (own before reference, then the lowest)."""
    covering = competing.where("src_start <= start and src_end >= end")
    order = F.struct((F.col("src_end") - F.col("src_start")).alias("len"), "ref", "src_start", "src_end")
    return covering.groupBy("chr", "start", "end").agg(F.min(order).alias("_w")).select(
        "chr", "start", "end", F.col("_w.src_start").alias("src_start"), F.col("_w.src_end").alias("src_end")
    )


def dominant_steps(steps: DataFrame, winners: DataFrame) -> DataFrame:
    """Steps of the winning source that lie inside the merged interval it won."""
    won = winners.select("chr", F.col("start").alias("island"), *SOURCE)
    # a step is a member of one merged interval, and lies inside it
    members = steps if "island" in steps.columns else with_islands(steps)
    return members.join(won, ["chr", "island", *SOURCE]).select("chr", "start", "end", "step", "name", *SOURCE)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition in order: only the record that is still open is held, across batches too."""
    key = start = end = None
    names: list[str] = []
    rows: list[tuple] = []

    def out() -> pa.RecordBatch:
        columns = list(zip(*rows))
        rows.clear()
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["chr", "start", "end", "name"])

    for batch in batches:
        for chr_, source, s, e, name, n in zip(*(c.to_pylist() for c in batch.columns)):
            if key == (chr_, source) and s < end and e > start:
                end = max(end, e)
                names += [name] * n
                continue
            if key is not None:
                rows.append((key[0], start, end, "+".join(names)))
            key, start, end, names = (chr_, source), s, e, [name] * n
        if rows:
            yield out()
    if key is not None:
        rows.append((key[0], start, end, "+".join(names)))
        yield out()


def fold_steps(dominant: DataFrame) -> DataFrame:
    """Fold overlapping steps (touching ones apart) into one record named by its ``+``-joined step types.

    The order is source start, then step. Steps of different source starts belong to different merged intervals
    and cannot overlap, so a fold never crosses a source start; equal steps of many samples are counted first. The steps of a
    source stream through a task in order and are never gathered, so a source with very many costs time but no memory.
    """
    counted = dominant.groupBy("chr", "src_start", "step", "start", "end", simple_mutation(F.col("name")).alias("name")).agg(
        F.count("*").alias("n")
    )
    ordered = counted.repartition("chr", "src_start").sortWithinPartitions("chr", "src_start", "step", "start", "end", "name", "n")
    rows = ordered.select("chr", F.col("src_start").cast("long"), F.col("start").cast("long"), F.col("end").cast("long"), "name", "n")
    return rows.mapInArrow(_folded, "chr string, start long, end long, name string")


def regional_dominance(results: DataFrame, threshold: float = 98.0) -> DataFrame:
    """Result rows to final calls: steps, competing sources, winners, folded records."""
    steps = materialise(with_islands(materialise(call_steps(results, threshold))))  # both are read twice
    winners = materialise(winning_sources(competing_sources(steps, reference_regions(results, threshold))))
    return fold_steps(dominant_steps(steps, winners))


def hash_colour(name: str) -> Column:
    """A stable ``r,g,b`` colour for a call name."""
    h = F.xxhash64(name)
    return F.concat_ws(",", *[F.pmod(F.shiftright(h, 8 * k), F.lit(256)).cast("string") for k in range(3)])
