"""Genotype table and VCF records from result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainweave.functions.scalars import simple_mutation

REGION = ["seqname", "start", "end"]
# fixed patterns of sample names: what is no sample of its own, the part that names the sample, and the second haplotype
NO_SAMPLE, SAMPLE_ID, SECOND = "\\.alt$", "^[^_]+_([^\\._]+).*", "h[ap]{0,2}2"
NOT_CALLS = ("ref", "UNK", ".")


def haplotype_calls(results: DataFrame, threshold: float = 98.0) -> DataFrame:
    """Result rows with sample id, haplotype and simplified call; weak calls are ``UNK``, ``.alt`` samples go."""
    return (
        results.where(~F.col("sample").rlike(NO_SAMPLE))
        .withColumns(
            {
                "sample_id": F.regexp_replace("sample", SAMPLE_ID, "$1"),
                "phase": F.when(F.col("sample").rlike(SECOND), 2).otherwise(1),
                "mutation": simple_mutation(F.when(F.col("res_max") < threshold, "UNK").otherwise(F.col("mut_max"))),
            }
        )
    )


def called(calls: DataFrame, ps: str = "start") -> DataFrame:
    """One row per region and mutation: ``calls`` has sample_id, ``gt`` such as ``1|0`` and its phase set for each sample of the whole input.

    All rows of a haplotype count: it is 1 if any of them has the mutation, else 0 if any has a known call, else ``.``.
    The phase set is ``start`` (or ``start-end``) of the only mutated haplotype. Samples without a row in a region are
    ``.|.`` there.
    """
    mutations = calls.where(~F.col("mutation").isin(*NOT_CALLS)).groupBy(*REGION, "mutation").agg(F.max("width_orig").alias("width_orig"))
    known = F.col("call") != "UNK"

    def side(phase: int, mutation: bool) -> Column:
        own = F.col("phase") == phase
        return F.max(own & (F.col("call") == F.col("mutation")) if mutation else own & known)

    # a row for each call of a region: its mutations are few, so each of them meets each haplotype's calls
    seen = calls.select(*REGION, "sample_id", "phase", F.col("mutation").alias("call")).distinct()
    found = mutations.select(*REGION, "mutation").join(seen, REGION).groupBy(*REGION, "mutation", "sample_id").agg(
        *[side(p, m).alias(f"_{'has' if m else 'known'}{p}") for p in (1, 2) for m in (True, False)]
    )

    sides = ["_has1", "_known1", "_has2", "_known2"]
    by_mutation = found.groupBy(*REGION, "mutation").agg(F.collect_list(F.struct("sample_id", *sides)).alias("_found"))
    none = F.array().cast(by_mutation.schema["_found"].dataType)
    unseen = F.transform(
        F.array_except("_all", "_found.sample_id"),
        lambda name: F.struct(name.alias("sample_id"), *[F.lit(None).cast("boolean").alias(c) for c in sides]),
    )
    ps_value = F.col("start").cast("string") if ps == "start" else F.concat_ws("-", F.col("start").cast("string"), F.col("end").cast("string"))

    def shown(c: Column) -> Column:
        sure = [F.when(c[f"_has{p}"], "1").when(c[f"_known{p}"], "0").otherwise(".") for p in (1, 2)]
        one, two = F.coalesce(c["_has1"], F.lit(False)), F.coalesce(c["_has2"], F.lit(False))
        return F.struct(c["sample_id"].alias("sample_id"), F.concat_ws("|", *sure).alias("gt"), F.when(one != two, ps_value).otherwise(".").alias("ps"))

    # the samples' names, as a VCF's header line has them
    cohort = F.broadcast(calls.agg(F.collect_set("sample_id").alias("_all")))
    return (
        # every mutation with every sample, made where the mutation is
        mutations.join(by_mutation, [*REGION, "mutation"], "left").withColumn("_found", F.coalesce("_found", none)).crossJoin(cohort)
        .select(*REGION, "mutation", "width_orig", F.transform(F.concat("_found", unseen), shown).alias("calls"))
    )


def genotypes(calls: DataFrame, ps: str = "start") -> DataFrame:
    """``called`` as one row per region, mutation and sample."""
    return called(calls, ps).select(*REGION, "mutation", "width_orig", F.inline("calls"))


def vcf_fixed(table: DataFrame, id_prefix: str = "SV") -> DataFrame:
    """The nine fixed VCF columns of each (region, mutation)."""
    place = F.concat_ws("-", "seqname", F.col("start").cast("string"), F.col("end").cast("string"))
    info = F.concat(
        F.lit("SVTYPE="), "mutation", F.lit(";SVDEPTH="), F.size(F.split("mutation", "\\+")).cast("string"),
        F.lit(";SVLEN="), F.col("width_orig").cast("string"), F.lit(";END="), F.col("end").cast("string"),
    )
    return table.select(
        F.col("seqname").alias("CHROM"), F.col("start").alias("POS"),
        F.concat(F.lit(f"<{id_prefix}."), "mutation", F.lit("_"), place, F.lit(">")).alias("ID"),
        F.lit("N").alias("REF"), F.concat(F.lit("<"), "mutation", F.lit(">")).alias("ALT"),
        F.lit(".").alias("QUAL"), F.lit("PASS").alias("FILTER"), info.alias("INFO"), F.lit("GT:PS").alias("FORMAT"),
        *[c for c in table.columns if c not in (*REGION, "mutation", "width_orig")],
    )


def vcf_records(genotype_rows: DataFrame, id_prefix: str = "SV") -> DataFrame:
    """Genotype rows as VCF records: the fixed columns and ``calls``, an array of (sample, ``GT:PS``) in sample order.

    The schema does not depend on the data, and the samples' names stay in the rows. Only a writer, which needs a
    header line, lists them.
    """
    call = F.struct(F.col("sample_id").alias("sample"), F.concat_ws(":", "gt", "ps").alias("call"))
    rows = genotype_rows.groupBy(*REGION, "mutation", "width_orig").agg(F.sort_array(F.collect_list(call)).alias("calls"))
    return vcf_fixed(rows, id_prefix)


def called_records(calls: DataFrame, id_prefix: str = "SV", ps: str = "start") -> DataFrame:
    """What ``vcf_records`` makes of the genotype rows of haplotype calls, without rows for single samples."""
    records = called(calls, ps)
    text = F.transform("calls", lambda c: F.struct(c["sample_id"].alias("sample"), F.concat_ws(":", c["gt"], c["ps"]).alias("call")))
    return vcf_fixed(records.withColumn("calls", F.sort_array(text)), id_prefix)
