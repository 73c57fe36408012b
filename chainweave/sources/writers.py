"""Writers. Each writes a folder of part files; concatenated in name order they are the plain file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainweave.operators.genotypes import vcf_records

# fixed VCF header lines
VCF_VERSION = "##fileformat=VCFv4.2"
VCF_DEFINITIONS = (
    '##INFO=<ID=SVTYPE,Number=1,Type=String,Description="SV type">',
    '##INFO=<ID=SVDEPTH,Number=1,Type=Integer,Description="SV depth, i.e number of consecutive SVs the variant represents">',
    '##INFO=<ID=SVLEN,Number=1,Type=Integer,Description="SV length">',
    '##INFO=<ID=END,Number=1,Type=Integer,Description="End position of the variant described in this record">',
    '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
    '##FORMAT=<ID=PS,Number=1,Type=Integer,Description="Phase set identifier">',
)


def _tab(columns: list[str]) -> Column:
    return F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in columns]).alias("value")


def write_bed(df: DataFrame, path: str, columns: tuple[str, ...] = ("chr", "start", "end"), mode: str = "error") -> None:
    df.orderBy("chr", "start", "end").select(_tab(list(columns))).write.mode(mode).text(path)


def write_paf(df: DataFrame, path: str, mode: str = "error") -> None:
    """Unoriented PAF rows; fixed columns that are missing are written as 0 or ``*``."""
    from chainweave.sources.readers import PAF_COLUMNS

    full = df.select(
        *[
            F.col(c) if c in df.columns else F.lit("*" if t == "string" else 0).alias(c)
            for c, t in PAF_COLUMNS.items()
        ]
    )
    full.select(_tab(list(PAF_COLUMNS))).write.mode(mode).text(path)


def write_results(df: DataFrame, path: str, mode: str = "error") -> None:
    """Result rows as one TSV table with a header, in the order of the genome; ``region`` names a row's region.

    The flat columns hold three steps; ``mut_steps`` behind them names the places of all (``start-end``, joined by ``+``), so that longer chains
    survive the file.
    """
    from chainweave.plans.regions import RESULT_COLUMNS

    place = F.concat_ws("-", "seqname", F.col("start").cast("string"), F.col("end").cast("string"))
    steps = []
    if "mut_steps" in df.columns:
        joined = F.array_join(F.transform("mut_steps", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string"))), "+")
        steps = [F.when(F.size("mut_steps") > 0, joined).alias("mut_steps")]
    rows = df.select(*RESULT_COLUMNS, place.alias("region"), *steps).orderBy("seqname", "start", "end")
    rows.write.mode(mode).option("sep", "\t").option("header", True).option("nullValue", "NA").csv(path)


def write_fasta(seqs: DataFrame, path: str, mode: str = "error") -> None:
    seqs.select(F.concat(F.lit(">"), F.col("name"), F.lit("\n"), F.col("seq")).alias("value")).write.mode(mode).text(path)


def write_vcf(genotype_rows: DataFrame, path: str, mode: str = "error", id_prefix: str = "SV") -> None:
    """VCF 4.2, sorted by CHROM and POS. The header lines sort into the first part."""
    records = vcf_records(genotype_rows, id_prefix)
    spark = records.sparkSession
    fields = [c for c in records.columns if c != "calls"]
    # the header line names all samples: it is made from one record, as every record has the same, and never leaves Spark
    named = records.limit(1).select(F.concat_ws("\t", F.lit("#" + "\t".join(fields)), F.array_join("calls.sample", "\t")).alias("value"))
    bare = spark.createDataFrame([("#" + "\t".join(fields),)], "value string")
    columns = named.unionByName(bare.join(records.limit(1).select(F.lit(True)), how="left_anti")).select(
        F.lit(3).alias("block"), F.lit("").alias("chrom"), F.lit(0).cast("long").alias("pos"), "value"
    )
    fixed = [(0, 0, VCF_VERSION)] + [(2, i, line) for i, line in enumerate(VCF_DEFINITIONS)]
    head = spark.createDataFrame(fixed, "block int, at int, value string").select(
        "block", F.lit("").alias("chrom"), F.col("at").cast("long").alias("pos"), "value"
    )
    contigs = records.select("CHROM").distinct().select(
        F.lit(1).alias("block"), F.col("CHROM").alias("chrom"), F.lit(0).cast("long").alias("pos"),
        F.concat(F.lit("##contig=<ID="), F.col("CHROM"), F.lit(">")).alias("value"),
    )
    body = records.select(
        F.lit(4).alias("block"), F.col("CHROM").alias("chrom"), F.col("POS").alias("pos"),
        F.concat_ws("\t", _tab(fields), F.array_join("calls.call", "\t")).alias("value"),
    )
    head.unionByName(columns).unionByName(contigs).unionByName(body).orderBy("block", "chrom", "pos", "value").select("value").write.mode(
        mode
    ).text(path)
