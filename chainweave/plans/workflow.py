"""The three ways to run: given windows, discovered windows, or whole sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainweave.config import RunConfig
from chainweave.operators import liftover as lo
from chainweave.plans import alignment as al
from chainweave.plans import discovery
from chainweave.plans.regions import solve_regions
from chainweave.session import materialise

FAILED = "no counterpart"


def call_regions(
    regions: DataFrame, seqs: DataFrame, other_lengths: DataFrame, align: al.Aligner, config: RunConfig = RunConfig()
) -> DataFrame:
    """Calls for given windows. ``regions``: region_id, seqname, start, end; ``seqs``: the reference sequences.

    Every region comes back; one without a counterpart has the status ``no counterpart`` and no scores.
    """
    places = materialise(al.counterpart_regions(regions, seqs, other_lengths, align, config.pad_factor))
    return _called(places, al.region_alignments(places, seqs, align), other_lengths, config)


def _called(places: DataFrame, alns: DataFrame, other_lengths: DataFrame, config: RunConfig) -> DataFrame:
    lengths = other_lengths.select("contig", F.col("length").alias("y_length"))
    found = places.where("contig is not null").join(lengths, "contig", "left").select(
        "region_id", "seqname", "start", "end", "exceeds_x", F.col("contig").alias("y_seqname"),
        F.col("lift_start").alias("y_start"), F.col("lift_end").alias("y_end"), "y_length",
    )
    solved = materialise(solve_regions(found, alns, config))
    lost = places.where("contig is null").select(
        "region_id", F.lit(FAILED).alias("status"), "seqname", "start", "end", "exceeds_x", F.lit("ref").alias("mut_max")
    )
    return solved.unionByName(lost, allowMissingColumns=True)


def call_given(
    regions: DataFrame, paf: DataFrame, lengths: DataFrame, other_lengths: DataFrame, config: RunConfig = RunConfig(), mode: str = "refine"
) -> DataFrame:
    """Calls for given windows from given alignments of the assemblies (regions' contigs as queries), without an aligner.

    ``lengths`` and ``other_lengths`` have contig and length. Every region comes back; one without a counterpart has the status ``no counterpart``.
    ``postprocess`` turns the rows into BED and VCF.
    """
    padded = materialise(al.padded_regions(regions, lengths, config.pad_factor))
    places = materialise(padded.join(lo.lift_regions(padded, paf, other_lengths, config.n_probes, mode), "region_id"))
    return _called(places, al.given_alignments(places, paf), other_lengths, config)


def call_genome(
    paf: DataFrame, seqs: DataFrame, genome: DataFrame, other_lengths: DataFrame, align: al.Aligner,
    mask: DataFrame | None = None, config: RunConfig = RunConfig(),
) -> DataFrame:
    """Calls for windows found by discovery in whole-assembly alignments (reference as target)."""
    windows = discovery.scan_for_windows(paf, genome, config.window_distances, mask)
    named = materialise(
        windows.select(F.monotonically_increasing_id().alias("region_id"), F.col("chr").alias("seqname"), "start", "end")
    )
    return call_regions(named, seqs, other_lengths, align, config)


def call_sequences(seqs: DataFrame, alns: DataFrame, config: RunConfig = RunConfig()) -> DataFrame:
    """Calls for whole sequence records with given alignments (region_id is the record name)."""
    return solve_regions(al.whole_records(seqs), alns, config)
