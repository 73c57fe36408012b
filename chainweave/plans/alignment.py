"""From sequences to merged alignments: chunk, align, put back, join up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainweave.operators import alignments as aln
from chainweave.operators import liftover as lo
from chainweave.operators import sequences as sq
from chainweave.operators.rangejoin import overlap_join
from chainweave.session import materialise

GENOME_CHUNK = 10_000  # fixed chunk length of whole-assembly alignment
SEARCH_MARGIN = 0.2  # a region is searched with a fifth of its length on either side

Aligner = Callable[[DataFrame], DataFrame]  # (name, seq) rows to PAF rows


def chunked_alignment(seqs: DataFrame, align: Aligner, chunk: int = GENOME_CHUNK) -> DataFrame:
    """Align whole contigs in chunks and merge the chunks that continue each other.

    The aligner's output is written down, so a later failure does not align again.
    """
    # the aligner is costly per byte: give every core several pieces of work
    spark = seqs.sparkSession
    pieces = sq.shred(seqs, chunk).repartition(4 * spark.sparkContext.defaultParallelism)
    raw = materialise(align(pieces.select("name", "seq")))
    placed = aln.shift_chunk_coordinates(raw).withColumn("qname", aln.strip_chunk_suffix("qname"))
    return aln.chain_merge(placed.drop("qlen", "tlen", "mapq"), F.lit(chunk).cast("long"))


def conversion_alignment(regions: DataFrame, seqs: DataFrame, align: Aligner) -> DataFrame:
    """Alignments of each region and its margins to the other assembly, in contig coordinates.

    ``regions``: region_id, seqname, start, end. Names carry ``contig:start-end``, which is taken off again.
    """
    margin = ((F.col("end") - F.col("start")) * SEARCH_MARGIN).cast("long")
    wide = regions.select(
        "region_id", "seqname", F.greatest(F.col("start") - margin, F.lit(0).cast("long")).alias("start"),
        (F.col("end") + margin).alias("end"),
    )
    found = materialise(align(sq.extract(wide, seqs).where("bases <> ''").select("name", F.col("bases").alias("seq"))))
    return lo.shift_extracted(found, "qname", "qstart", "qend")


def counterpart_regions(
    regions: DataFrame, seqs: DataFrame, other_lengths: DataFrame, align: Aligner, factor: float = 1.0
) -> DataFrame:
    """Pad the regions, find their place on the other assembly, and keep what failed with nulls.

    ``other_lengths`` has contig and length. Adds contig, method, lift_start and lift_end.
    """
    padded = materialise(padded_regions(regions, sq.lengths(seqs).select(F.col("name").alias("contig"), "length"), factor))
    paf = conversion_alignment(padded, seqs, align)
    return padded.join(lo.lift_regions(padded, paf, other_lengths), "region_id")


def padded_regions(regions: DataFrame, lengths: DataFrame, factor: float = 1.0) -> DataFrame:
    """Regions widened by a factor within their contig (``lengths``: contig, length). One on an unknown contig stays as it is."""
    from chainweave.operators.intervals import enlarge

    named = lengths.select(F.col("contig").alias("seqname"), "length")
    wide = enlarge(regions.join(named, "seqname"), factor, F.col("length")).select(
        "region_id", "seqname", F.col("start_pad").alias("start"), F.col("end_pad").alias("end"), "exceeds_x"
    )
    unknown = regions.join(named, "seqname", "left_anti").select("region_id", "seqname", "start", "end", F.lit(None).cast("boolean").alias("exceeds_x"))
    return wide.unionByName(unknown)


def given_alignments(places: DataFrame, paf: DataFrame) -> DataFrame:
    """Alignments of each region with its counterpart, cut out of given alignments of the assemblies, in coordinates of the two extracts.

    ``places``: region_id, seqname, start, end, contig, lift_start, lift_end. An alignment is cut to the region, then to the counterpart; what a side
    loses, the other loses too. Matches are shared out by length. The region becomes the target (x) and the counterpart the query (y).
    """
    whole = places.where("contig is not null").select("region_id", "seqname", F.col("start").alias("_rs"), F.col("end").alias("_re"), "contig", "lift_start", "lift_end")
    rows = paf.select(F.col("qname").alias("seqname"), "qstart", "qend", "strand", "tname", "tstart", "tend", "nmatch")
    met = overlap_join(whole, rows, ["seqname"], ("_rs", "_re"), ("qstart", "qend")).where("tname = contig")
    plus = F.col("strand") == "+"

    def trimmed(df: DataFrame, first: tuple[str, str], second: tuple[str, str], lo: str, hi: str) -> DataFrame:
        """Cut the first axis to lo and hi, and the second by as much."""
        front, back = F.greatest(F.col(lo) - F.col(first[0]), F.lit(0)), F.greatest(F.col(first[1]) - F.col(hi), F.lit(0))
        cut = df.withColumns({"_f": front, "_b": back})
        return cut.withColumns({
            first[0]: F.col(first[0]) + F.col("_f"), first[1]: F.col(first[1]) - F.col("_b"),
            second[0]: F.col(second[0]) + F.when(plus, F.col("_f")).otherwise(F.col("_b")),
            second[1]: F.col(second[1]) - F.when(plus, F.col("_b")).otherwise(F.col("_f")),
        })

    sized = met.withColumn("_size", F.col("qend") - F.col("qstart"))
    cut = trimmed(trimmed(sized, ("qstart", "qend"), ("tstart", "tend"), "_rs", "_re"), ("tstart", "tend"), ("qstart", "qend"), "lift_start", "lift_end")
    length = F.col("qend") - F.col("qstart")
    return cut.where("qstart < qend and tstart < tend").select(
        "region_id", F.col("tname").alias("qname"), (F.col("tstart") - F.col("lift_start")).alias("qstart"),
        (F.col("tend") - F.col("lift_start")).alias("qend"), "strand", F.concat(F.lit("r"), F.col("region_id").cast("string")).alias("tname"),
        (F.col("qstart") - F.col("_rs")).alias("tstart"), (F.col("qend") - F.col("_rs")).alias("tend"),
        F.floor(F.col("nmatch") * length / F.col("_size")).cast("long").alias("nmatch"), length.alias("alen"),
    )


def whole_records(seqs: DataFrame) -> DataFrame:
    """One region per sequence record, for comparing whole sequences without liftover."""
    return seqs.select(
        F.col("name").alias("region_id"), F.col("name").alias("seqname"), F.lit(0).cast("long").alias("start"),
        F.length("seq").cast("long").alias("end"),
    )


def region_alignments(places: DataFrame, seqs: DataFrame, align: Aligner) -> DataFrame:
    """Detailed alignments of each region against its counterpart, in coordinates of the two extracts.

    ``places``: region_id, seqname, start, end, contig, lift_start, lift_end. All regions are cut into chunks of their
    own length class and aligned in one go; hits outside a region's counterpart are left out. The region becomes
    the target (x) and the counterpart the query (y).
    """
    from chainweave.functions.scalars import chunk_length

    places = places.where("contig is not null").withColumn("chunk", chunk_length(F.col("end") - F.col("start")).cast("long"))
    cut = sq.extract(places, seqs)
    tagged = cut.select(F.concat(F.lit("r"), F.col("region_id").cast("string")).alias("name"), F.col("bases").alias("seq"), "chunk")
    cores = seqs.sparkSession.sparkContext.defaultParallelism
    pieces = sq.shred(tagged, F.col("chunk")).repartition(4 * cores)
    raw = materialise(align(pieces.select("name", "seq")))
    placed = aln.shift_chunk_coordinates(raw).withColumn("_tag", aln.strip_chunk_suffix("qname"))
    where = places.select(
        "region_id", F.concat(F.lit("r"), F.col("region_id").cast("string")).alias("_tag"), "contig", "lift_start", "lift_end", "chunk"
    )
    inside = placed.join(where, "_tag").where("tname = contig and tstart >= lift_start and tend <= lift_end")
    swapped = inside.select(
        "region_id", "chunk", F.col("tname").alias("qname"), (F.col("tstart") - F.col("lift_start")).alias("qstart"),
        (F.col("tend") - F.col("lift_start")).alias("qend"), "strand", F.col("_tag").alias("tname"),
        F.col("qstart").alias("tstart"), F.col("qend").alias("tend"), "nmatch", "alen",
    )
    merged = aln.chain_merge(swapped, F.col("chunk"), keys=["region_id", "qname", "tname", "chunk"])
    return merged.drop("chunk", "members")
