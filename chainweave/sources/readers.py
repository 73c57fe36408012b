"""Readers for alignment, interval, sequence and result files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAF_COLUMNS = {
    "qname": "string", "qlen": "long", "qstart": "long", "qend": "long", "strand": "string", "tname": "string",
    "tlen": "long", "tstart": "long", "tend": "long", "nmatch": "long", "alen": "long", "mapq": "int",
}

_RESULT_TYPES = {
    "string": ("seqname", "sample", "y_seqname", "mut_max"),
    "boolean": ("exceeds_x", "exceeds_y", "grid_inconsistency", "flip_unsure", "cluttered_boundaries"),
    "double": ("xpad", "res_ref", "res_max"),
}


def read_paf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The twelve fixed PAF columns; tag columns may follow in any number and are left out."""
    fields = F.split("value", "\t")
    return (
        spark.read.text(path)
        .where(F.size(fields) >= len(PAF_COLUMNS))
        .select(*[fields.getItem(i).cast(t).alias(n) for i, (n, t) in enumerate(PAF_COLUMNS.items())])
    )


def read_bed(spark: SparkSession, path: str | list[str], columns: tuple[str, ...] = ("chr", "start", "end")) -> DataFrame:
    """BED intervals; ``columns`` names the leading fields (a fourth and further ones are strings)."""
    fields = F.split("value", "\t")
    typed = [
        fields.getItem(i).cast("long" if n in ("start", "end") else "string").alias(n) for i, n in enumerate(columns)
    ]
    lines = spark.read.text(path).where(~F.col("value").rlike("^(#|track|browser|\\s*$)"))
    return lines.where(F.size(fields) >= len(columns)).select(*typed)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Gene track: BED4."""
    return read_bed(spark, path, ("chr", "start", "end", "name"))


def read_genome(spark: SparkSession, path: str) -> DataFrame:
    """Contig lengths from a FASTA index or a genome file: ``(chr, length)``."""
    fields = F.split("value", "\t")
    return spark.read.text(path).where(F.size(fields) >= 2).select(
        fields.getItem(0).alias("chr"), fields.getItem(1).cast("long").alias("length")
    )


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(name, seq)``, one row per record; the name ends at the first blank. A record must fit in one row."""
    record = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    head = F.substring_index("value", "\n", 1)
    return record.select(
        F.regexp_extract(head, "^(\\S+)", 1).alias("name"),
        F.regexp_replace(F.expr("substring(value, length(substring_index(value, '\\n', 1)) + 1)"), "\\s", "").alias("seq"),
    )


def read_results(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Result rows in their fixed column order, with the places of all steps where the file has them; ``NA`` is null."""
    from chainweave.plans.regions import RESULT_COLUMNS

    raw = spark.read.option("sep", "\t").option("header", True).option("nullValue", "NA").csv(path)

    def cast_of(c: str) -> str:
        return next((t for t, names in _RESULT_TYPES.items() if c in names), "long")

    steps = ["mut_steps"] if "mut_steps" in raw.columns else []
    return raw.select(*[F.col(c).cast(cast_of(c)).alias(c) for c in RESULT_COLUMNS if c in raw.columns], *steps)


def parse_region(text: Column) -> Column:
    """``chr:start-end`` as a struct; read from the right, so names may hold ``-`` and ``:``."""
    pattern = "^(.*):([0-9]+)-([0-9]+)$"
    return F.struct(
        F.regexp_extract(text, pattern, 1).alias("chr"),
        F.regexp_extract(text, pattern, 2).cast("long").alias("start"),
        F.regexp_extract(text, pattern, 3).cast("long").alias("end"),
    )


def read_highlights(spark: SparkSession, path: str, kind: str = "bed") -> DataFrame:
    """Highlight intervals from a BED or a PAF file (the target spans of the latter)."""
    if kind == "paf":
        return read_paf(spark, path).select(
            F.col("tname").alias("chr"), F.col("tstart").alias("start"), F.col("tend").alias("end")
        )
    return read_bed(spark, path)
