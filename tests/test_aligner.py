import sys

from pyspark.sql import functions as F

from chainweave.functions import scalars as sc
from chainweave.operators import alignments as aln
from chainweave.operators import sequences as sq
from chainweave.plans import alignment as al
from chainweave.plans import workflow as wf
from chainweave.sources.aligner import align, aligner_command

# stands in for an aligner: places every exact occurrence of a record in the reference
FINDER = """
import sys
ref = {ref!r}
name = None
for line in sys.stdin.read().split():
    if line[0] == '>':
        name = line[1:]
        continue
    at = ref.find(line) if line else -1
    while at >= 0:
        print(name, len(line), 0, len(line), '+', 'chrT', len(ref), at, at + len(line), len(line), len(line), 60, 'tp:A:P', sep='\\t')
        at = ref.find(line, at + 1)
"""


def finder(ref):
    command = [sys.executable, "-c", FINDER.format(ref=ref)]
    return lambda seqs: align(seqs, command)


def sequence(n):
    state, out = 7, []
    for _ in range(n):
        state = (state * 1103515245 + 12345) % (1 << 31)
        out.append("ACGT"[(state >> 16) % 4])
    return "".join(out)


def test_chunks_are_aligned_and_joined_up(spark):
    ref = sequence(30_000)
    seqs = spark.createDataFrame([("ctg", ref[5000:25_000])], "name string, seq string")
    row = al.chunked_alignment(seqs, finder(ref), chunk=1000).select("qname", "tname", "tstart", "tend", "qstart", "qend", "members")
    assert [tuple(r) for r in row.collect()] == [("ctg", "chrT", 5000, 24_999, 0, 19_999, 20)]


def test_region_finds_its_counterpart(spark):
    ref = sequence(20_000)
    seqs = spark.createDataFrame([("c", ref[2000:18_000])], "name string, seq string")
    regions = spark.createDataFrame([(1, "c", 5000, 9000)], "region_id long, seqname string, start long, end long")
    lengths = spark.createDataFrame([("chrT", 20_000)], "contig string, length long")
    got = al.counterpart_regions(regions, seqs, lengths, finder(ref)).first()
    # 7000-11000 on the other side, widened by a quarter on each side
    assert (got.contig, got.lift_start, got.lift_end) == ("chrT", 6000, 11_999)


def test_deletion_between_repeats_is_called(spark):
    repeat, rest = sequence(40_000)[:6000], sequence(40_000)[6000:]
    left, middle, right = rest[:10_000], rest[10_000:16_000], rest[16_000:28_000]
    reference = left + repeat + middle + repeat + right
    other = left + repeat + right
    seqs = spark.createDataFrame([("c", reference)], "name string, seq string")
    regions = spark.createDataFrame(
        [(1, "c", 0, len(reference)), (2, "gone", 0, 10)], "region_id long, seqname string, start long, end long"
    )
    both = seqs.unionByName(spark.createDataFrame([("gone", "ACGTACGTAC")], "name string, seq string"))
    lengths = spark.createDataFrame([("chrT", len(other))], "contig string, length long")

    def blast_like(rows):
        # whole regions do not occur exactly in the other sequence, so they go in as chunks and come back as contigs
        cut = sq.shred(rows, 500)
        hits = align(cut, [sys.executable, "-c", FINDER.format(ref=other)])
        return aln.shift_chunk_coordinates(hits).withColumn("qname", aln.strip_chunk_suffix("qname"))

    rows = {r.region_id: r for r in wf.call_regions(regions, both, lengths, blast_like).collect()}
    assert rows[2].status == "no counterpart"
    assert rows[1].status == "gridded" and rows[1].res_max > 95 > rows[1].res_ref
    assert rows[1].mut_max.endswith("del") and abs(rows[1].mut1_len - 12_000) <= 1000


def test_presets_follow_the_query_size():
    assert "asm20" in aligner_command("r.fa") and "asm5" in aligner_command("r.fa", 7_000_000)


def test_block_positions_and_colours(spark):
    row = spark.range(1).select(
        sc.block_positions(F.array(*[F.lit(v).cast("long") for v in (100, 50, 30)]), F.struct(F.lit(1).alias("start"), F.lit(3).alias("stop"))).alias("p"),
        sc.is_colour(F.lit("#ff0000")).alias("a"), sc.is_colour(F.lit("#zz")).alias("b"),
    ).first()
    assert tuple(row.p) == (50, 165, 50, 115, 65) and row.a and not row.b
