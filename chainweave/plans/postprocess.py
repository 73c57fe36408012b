"""Result rows to deliverables: dominance BED and VCF."""

from __future__ import annotations

from pyspark.sql import DataFrame

from chainweave.operators.calls import regional_dominance
from chainweave.operators.genotypes import genotypes, haplotype_calls
from chainweave.session import materialise
from chainweave.sources.writers import write_bed, write_vcf


def dominance_bed(results: DataFrame, path: str, threshold: float = 98.0) -> DataFrame:
    calls = materialise(regional_dominance(results, threshold))
    write_bed(calls, path, ("chr", "start", "end", "name"), mode="overwrite")
    return calls


def vcf(results: DataFrame, path: str, threshold: float = 98.0, ps: str = "start") -> DataFrame:
    rows = materialise(genotypes(haplotype_calls(results, threshold), ps))
    write_vcf(rows, path, mode="overwrite")
    return rows
