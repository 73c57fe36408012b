import os

from pyspark.sql import functions as F

from chainweave.functions import scalars as sc
from chainweave.operators import calls as ca
from chainweave.operators import genotypes as gt
from chainweave.operators import liftover as lo
from chainweave.operators import plotdata as pd_
from chainweave.operators import sequences as sq
from chainweave.sources import readers, writers
from chainweave.streaming.results import append_results

PAF = "qname string, qstart long, qend long, strand string, tname string, tstart long, tend long, nmatch long, alen long"


def lines_of(path):
    parts = sorted(f for f in os.listdir(path) if f.startswith("part-"))
    return [line for f in parts for line in open(os.path.join(path, f)).read().splitlines()]


def test_point_liftover_golden(spark):
    paf = spark.createDataFrame([("q", 100, 200, "+", "t", 1000, 1100, 90, 100), ("m", 100, 200, "-", "t", 1000, 1100, 90, 100)], PAF)
    got = paf.select(lo.lifted_position(F.when(F.col("strand") == "+", 150).otherwise(120))).collect()
    assert [r[0] for r in got] == [1050, 1080]


def test_whole_region_lifts_to_its_place(spark):
    paf = spark.createDataFrame([("c", 0, 500_000, "-", "a", 200_000, 700_000, 499_000, 500_000), ("c", 100_000, 103_000, "+", "b", 0, 3000, 2000, 3000)], PAF)
    regions = spark.createDataFrame([(1, "c", 100_000, 160_000), (2, "none", 0, 100)], "region_id long, seqname string, start long, end long")
    lengths = spark.createDataFrame([("a", 800_000), ("b", 3000)], "contig string, length long")
    rows = {r.region_id: r for r in lo.lift_regions(regions, paf, lengths).collect()}
    # 60 kb lands on 540000-600000 and is widened by a tenth on each side
    assert (rows[1].contig, rows[1].method, rows[1].lift_start, rows[1].lift_end) == ("a", "range", 534_000, 605_999)
    assert rows[2].contig is None


def test_roles_and_offsets(spark):
    paf = spark.createDataFrame([("q", 1, 2, "+", "ctg:100-200_x", 5, 6, 1, 1)], PAF)
    assert lo.swap_roles(paf).first().qname == "ctg:100-200_x"
    moved = lo.shift_extracted(paf).first()
    assert (moved.tname, moved.tstart, moved.tend) == ("ctg", 105, 106)


def result_row(**kw):
    base = {"seqname": "chr1", "start": 1000, "end": 9000, "sample": "asm_S1_hap1", "res_max": 99.0, "mut_max": "1_2_inv", "width_orig": 8000}
    base |= {f"mut{n}_{c}": None for n in (1, 2, 3) for c in ("start", "end")}
    return base | kw


RESULT = (
    "seqname string, start long, end long, sample string, res_max double, mut_max string, width_orig long, mut1_start long, "
    "mut1_end long, mut2_start long, mut2_end long, mut3_start long, mut3_end long"
)


def results(spark, rows):
    names = [c.split()[0] for c in RESULT.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], RESULT)


def test_dominance_shortest_source_wins_and_steps_fold(spark):
    rows = [
        result_row(mut_max="1_2_inv+3_4_del", mut1_start=2000, mut1_end=4000, mut2_start=3000, mut2_end=5000),
        result_row(start=0, end=20_000, mut1_start=2500, mut1_end=3500),  # wider source: loses
        result_row(start=30_000, end=40_000, mut1_start=31_000, mut1_end=32_000, mut2_start=32_000, mut2_end=33_000, mut_max="1_2_dup+2_3_inv"),
        result_row(start=50_000, end=60_000, res_max=98.0, mut1_start=51_000, mut1_end=52_000),  # 98 is neither
    ]
    got = sorted(map(tuple, ca.regional_dominance(results(spark, rows)).collect()))
    # touching steps merge into one interval but stay two records
    assert got == [("chr1", 2000, 5000, "inv+del"), ("chr1", 31_000, 32_000, "dup"), ("chr1", 32_000, 33_000, "inv")]


def test_unsure_region_silences_the_interval(spark):
    rows = [
        result_row(start=0, end=20_000, mut1_start=2500, mut1_end=3500),
        result_row(start=2000, end=4000, res_max=90.0),
    ]
    assert ca.regional_dominance(results(spark, rows)).isEmpty()


def test_genotypes_and_vcf(spark, tmp_path):
    rows = [
        result_row(), result_row(sample="asm_S1_hap2", mut_max="ref"),
        result_row(sample="asm_S2_hap1"), result_row(sample="asm_S2_h2"),
        result_row(sample="asm_S3_hap1", res_max=50.0), result_row(sample="asm_S4.alt"),
        result_row(sample="asm_S5_hap2", start=50_000, end=60_000, mut_max="1_2_del+1_3_inv"),
    ]
    table = gt.genotypes(gt.haplotype_calls(results(spark, rows)))
    got = {(r.start, r.sample_id): (r.gt, r.ps) for r in table.collect()}
    # all samples of the input in every region; .alt is none
    want = {(at, s): (".|.", ".") for at in (1000, 50_000) for s in ("S1", "S2", "S3", "S5")}
    want |= {(1000, "S1"): ("1|0", "1000"), (1000, "S2"): ("1|1", "."), (50_000, "S5"): (".|1", "50000")}
    assert got == want
    writers.write_vcf(table, str(tmp_path / "v"))
    text = lines_of(tmp_path / "v")
    assert text[0] == "##fileformat=VCFv4.2" and text[1] == "##contig=<ID=chr1>"
    assert text[8].split("\t")[:2] == ["#CHROM", "POS"] and text[8].endswith("S1\tS2\tS3\tS5")
    assert text[9].split("\t")[9:] == ["1|0:1000", "1|1:.", ".|.:.", ".|.:."]
    assert "SVTYPE=del+inv;SVDEPTH=2" in text[10]


def test_every_row_of_a_haplotype_counts(spark):
    rows = [
        result_row(), result_row(res_max=50.0), result_row(sample="asm_S2_hap1", mut_max="1_3_del"), result_row(sample="asm_S2_hap1", mut_max="ref"),
        result_row(sample="asm_S9_hap1", start=90_000, end=95_000, mut_max="ref"),
    ]
    got = {(r.mutation, r.sample_id): r.gt for r in gt.genotypes(gt.haplotype_calls(results(spark, rows))).collect()}
    name = gt.haplotype_calls(results(spark, rows[:1])).first().mutation
    assert got == {(name, "S1"): "1|.", (name, "S2"): "0|.", (name, "S9"): ".|.", ("del", "S1"): "0|.", ("del", "S2"): "1|.", ("del", "S9"): ".|."}


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "a.paf").write_text("q\t10\t0\t9\t+\tt\t20\t1\t10\t8\t9\t60\ttp:A:P\tcm:i:3\nq\t10\t0\t5\t-\tt\t20\t1\t6\t5\t5\t0\n")
    paf = readers.read_paf(spark, str(tmp_path / "a.paf"))
    assert paf.count() == 2 and paf.first().tend == 10
    writers.write_paf(paf, str(tmp_path / "p"))
    assert lines_of(tmp_path / "p")[1].split("\t")[4] == "-"
    (tmp_path / "s.fa").write_text(">one first\nACG\nTNN\n>two\nacg\n")
    fasta = readers.read_fasta(spark, str(tmp_path / "s.fa"))
    assert sorted(map(tuple, fasta.collect())) == [("one", "ACGTNN"), ("two", "acg")]
    writers.write_fasta(fasta, str(tmp_path / "f"))
    assert sorted(map(tuple, readers.read_fasta(spark, str(tmp_path / "f" / "part-*")).collect())) == [("one", "ACGTNN"), ("two", "acg")]
    (tmp_path / "g.fai").write_text("c1\t500\t0\t60\t61\n")
    assert tuple(readers.read_genome(spark, str(tmp_path / "g.fai")).first()) == ("c1", 500)
    bed = spark.createDataFrame([("b", 5, 9), ("a", 1, 3)], "chr string, start long, end long")
    writers.write_bed(bed, str(tmp_path / "b"))
    assert sorted(map(tuple, readers.read_bed(spark, str(tmp_path / "b")).collect())) == [("a", 1, 3), ("b", 5, 9)]
    region = spark.createDataFrame([("HLA-A:x:10-20",)], "r string").select(readers.parse_region(F.col("r")).alias("r")).first().r
    assert tuple(region) == ("HLA-A:x", 10, 20)


def test_sequences(spark):
    df = spark.createDataFrame([("c", "ACGTacgtNNRY-")], "name string, seq string")
    assert df.select(sc.reverse_complement(F.col("seq"))).first()[0] == "RYNNACGTACGT"
    chunks = sq.shred(df, 5).select("name", "seq").collect()
    assert [tuple(r) for r in chunks] == [("c_0-4", "ACGT"), ("c_5-9", "cgtN"), ("c_10-13", "RY-")]
    regions = spark.createDataFrame([(1, "c", 2, 99)], "region_id long, seqname string, start long, end long")
    assert sq.extract(regions, df).first().bases == "GTacgtNNRY-"


def test_names_and_order(spark):
    df = spark.createDataFrame([("CP068277.2",), ("CP068255.2",), ("CP086569.2",), ("other",)], "c string")
    assert [r[0] for r in df.select(sc.readable_chromosome(F.col("c"))).collect()] == ["chr1", "chrX", "chrY", "other"]
    chroms = spark.createDataFrame([(c,) for c in ["chrM", "chr10", "chrX", "chr2", "weird"]], "c string")
    assert [r[0] for r in chroms.orderBy(sc.karyotype_rank(F.col("c"))).collect()] == ["chr2", "chr10", "chrX", "chrM", "weird"]


def test_mutated_cells(spark):
    cells = spark.createDataFrame([(1, 1, 1, 5), (1, 2, 3, -7)], "region_id long, x long, y long, z long")
    states = spark.createDataFrame([(1, [-2, 1, 1])], "region_id long, idx array<int>")
    assert sorted(map(tuple, pd_.mutated_cells(cells, states).collect())) == [(1, 1, 3, 7), (1, 2, 1, 5), (1, 3, 1, 5)]


def test_streamed_results_arrive_once(spark, tmp_path):
    source = tmp_path / "in"
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, call string")
    rows.write.parquet(str(source))
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema(rows.schema).parquet(str(source))
        append_results(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_regions_off_their_contig_keep_a_row(spark):
    df = spark.createDataFrame([("a", "ACGT"), ("b", "ACGTACGTAC" * 3), ("e", "")], "name string, seq string")
    regions = spark.createDataFrame(
        [("a", 300, 400), ("a", -5, 3), ("b", 8, 23), ("b", 8, 23), ("x", 1, 2), ("e", 0, 5)], "seqname string, start long, end long"
    )
    got = sorted((r.seqname, r.start, r.end, r.status, r.name, r.bases) for r in sq.extract(regions, df, chunk=7).collect())
    b = ("b", 8, 23, "whole", "b:8-23", ("ACGTACGTAC" * 3)[8:23])
    assert got == [
        ("a", 0, 3, "clipped", "a:0-3", "ACG"), ("a", 4, 4, "outside", "a:4-4", ""), b, b, ("e", 0, 0, "outside", "e:0-0", ""),
        ("x", 1, 2, "unknown", None, None),
    ]


def test_shred_time_grows_with_the_record(spark):
    import time

    took = {}
    for mb in (2, 16):
        rows = spark.range(1).selectExpr("'c' as name", f"repeat('ACGTACGT', {mb * 125_000}) as seq")
        sq.shred(rows, 10_000).write.format("noop").mode("overwrite").save()
        start = time.time()
        assert sq.shred(rows, 10_000).count() == mb * 100
        took[mb] = time.time() - start
    assert took[16] < 30 * max(took[2], 0.1)


def test_a_fourth_step_is_a_call(spark):
    row = result_row(mut_max="1_2_inv+2_3_del+3_4_inv+4_5_dup")
    places = [(1000 * k, 1000 * k + 500) for k in range(1, 5)]
    df = results(spark, [row]).withColumn("mut_steps", F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in places]))
    got = sorted((r.step, r.start, r.end, r.name) for r in ca.call_steps(df).collect())
    assert got == [(k + 1, *places[k], n) for k, n in enumerate(row["mut_max"].split("+"))]


def test_results_are_one_table(spark, tmp_path):
    from chainweave.plans.regions import RESULT_COLUMNS

    flat = spark.range(5).select(
        *[F.concat(F.lit("chr"), F.col("id") % 2).alias(c) if c == "seqname" else (F.col("id") * 10).alias(c) if c in ("start", "end")
          else F.lit(None).cast("string").alias(c) for c in RESULT_COLUMNS]
    )
    writers.write_results(flat, str(tmp_path / "r"))
    assert not [p for p in (tmp_path / "r").iterdir() if p.is_dir()]
    back = readers.read_results(spark, str(tmp_path / "r"))
    assert back.columns == list(RESULT_COLUMNS) and sorted(r.start for r in back.collect()) == [0, 10, 20, 30, 40]


def test_median_by_ranges(spark):
    import random as rnd
    import statistics

    r = rnd.Random(3)
    for values in ([5], [3, 9], [r.randrange(-50, 10**12) for _ in range(301)], [7] * 40 + [8] * 40, [r.randrange(100) for _ in range(200)]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v long").repartition(3)
        assert pd_.exact_median(df, "v", ranges=5) == pd_.exact_median(df, "v") == statistics.median(values)
    assert pd_.exact_median(spark.createDataFrame([], "v long"), "v") is None
    assert pd_.window_summary(spark.createDataFrame([], "start long, end long")).first().n == 0


def test_steps_stream_through_the_fold(spark):
    """A source with very many steps: overlapping ones become one record, over the edges of batches too."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        df = spark.range(500).selectExpr(
            "'c' as chr", "cast(0 as long) as src_start", "cast(id as int) as step", "id * 10 as start",
            "case when id % 100 = 99 then id * 10 + 10 else id * 10 + 11 end as end", "'1_2_inv' as name",
        )
        got = sorted((r.start, r.end, r.name) for r in ca.fold_steps(df).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [(k * 1000, k * 1000 + 1000, "+".join(["inv"] * 100)) for k in range(5)]


def test_samples_of_a_mutation_are_not_shuffled(spark):
    """Forty samples of each of fifty mutations are made where the mutation is: the wide table is not shuffled."""
    rows = [("chr1", 10 * (i % 50), 10 * (i % 50) + 5, f"x_S{i % 40}_hap{1 + i % 2}", 99.0, "1_2_del", 5) for i in range(400)]
    df = spark.createDataFrame(rows, "seqname string, start long, end long, sample string, res_max double, mut_max string, width_orig long")
    calls = gt.haplotype_calls(df)
    records = gt.called_records(calls)
    assert {len(r.calls) for r in records.collect()} == {40} and records.count() == 50
    assert sorted(map(str, records.collect())) == sorted(map(str, gt.vcf_records(gt.genotypes(calls)).collect()))
    for made, wide in ((records, "transform("), (gt.genotypes(calls), "inline(")):
        plan = made._jdf.queryExecution().executedPlan().toString()  # from the result down
        assert "Exchange" not in plan[: plan.index(wide)]


def test_members_of_an_interval_are_not_joined_by_overlap(spark, monkeypatch):
    joins = []
    join = ca.overlap_join
    monkeypatch.setattr(ca, "overlap_join", lambda *args, **more: joins.append(1) or join(*args, **more))
    rows = [
        result_row(start=0, end=20_000, mut1_start=2500, mut1_end=3500), result_row(mut1_start=3500, mut1_end=4000),
        result_row(start=0, end=20_000, res_max=90.0), result_row(start=0, end=30_000, mut1_start=21_000, mut1_end=22_000),
    ]
    steps = ca.call_steps(results(spark, rows))
    winners = ca.winning_sources(ca.competing_sources(steps, ca.reference_regions(results(spark, rows))))
    assert sorted(map(tuple, winners.collect())) == [("chr1", 2500, 4000, 1000, 9000), ("chr1", 21_000, 22_000, 0, 30_000)]
    assert sorted(r.start for r in ca.dominant_steps(steps, winners).collect()) == [3500, 21_000]
    assert len(joins) == 1  # of the reference regions


def test_regions_within_a_chunk_are_not_gathered(spark):
    df = spark.createDataFrame([("a", "ACGTACGTACGTACGTACGTA")], "name string, seq string")
    regions = spark.createDataFrame([("a", 1, 6), ("a", 7, 14), ("a", 5, 16), ("a", 20, 40), ("a", 30, 30)], "seqname string, start long, end long")
    got = sq.extract(regions, df, chunk=7)
    assert sorted((r.start, r.end, r.status, r.bases) for r in got.collect()) == [
        (1, 6, "whole", "CGTAC"), (5, 16, "whole", "CGTACGTACGT"), (7, 14, "whole", "TACGTAC"), (20, 21, "clipped", "A"), (21, 21, "outside", ""),
    ]
    # of the two halves of the union, only that of regions over several chunks is grouped
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.split("Union")[1].index("Join") < plan.split("Union")[1].index("Aggregate")
