"""Sequence and plot-data queries: document texts serve as sequences, whole and unshortened."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainweave.catalog._registry import query
from chainweave.catalog.views import PAF, paf, table
from chainweave.functions import scalars as sc
from chainweave.operators import alignments as aln
from chainweave.operators import plotdata as pd_
from chainweave.operators import sequences as sq


def seqs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), F.col("text").alias("seq")
    )


SEQS = "seqs as (select concat('doc', doc_id) as name, text as seq from documents)"


@query("sequence_lengths", f"with {SEQS} select name, length(seq) as length from seqs")
def sequence_lengths(spark, sf_dir):
    return sq.lengths(seqs(spark, sf_dir))


@query("extract_subseq", f"""with {SEQS}, r as (select o_orderkey as region_id, concat('doc', o_custkey) as seqname,
    o_orderkey % 50 * 10 as "start", o_orderkey % 50 * 10 + 300 as "end" from orders),
  placed as (select r.*, seq, case when seq is null then "start" else least("start", length(seq)) end as s,
    case when seq is null then "end" else least("end", length(seq)) end as e from r left join seqs on name = seqname)
  select region_id, seqname, s as "start", e as "end",
    case when seq is null then 'unknown' when e <= s then 'outside' when s = "start" and e = "end" then 'whole' else 'clipped' end as status,
    case when seq is not null then concat(seqname, ':', s, '-', e) end as name, substring(seq, s + 1, e - s) as bases from placed""")
def extract_subseq(spark, sf_dir):
    at = F.col("o_orderkey") % 50 * 10
    regions = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("region_id"), F.concat(F.lit("doc"), F.col("o_custkey").cast("string")).alias("seqname"),
        at.alias("start"), (at + 300).alias("end"),
    )
    return sq.extract(regions, seqs(spark, sf_dir))


SHRED = """c as (select *, unnest(range(0, length(seq), 1000)) as s from seqs),
  e as (select name, s, least(s + 999, length(seq)) as e, seq from c),
  chunks as (select concat(name, '_', s, '-', e) as name, name as contig, s as "start", e as "end",
    substring(seq, s + 1, e - s) as seq from e where s < e)"""


@query("shred_sequences", f"with {SEQS}, {SHRED} select * from chunks")
def shred_sequences(spark, sf_dir):
    return sq.shred(seqs(spark, sf_dir), 1000)


@query("correct_chunks", f"""with {SEQS}, {SHRED} select regexp_replace(name, '_[0-9]+-[0-9]+$', '') as contig,
  "start" + 5 as qstart, "start" + length(seq) as qend from chunks""")
def correct_chunks(spark, sf_dir):
    """Coordinates within a chunk moved back to the contig."""
    within = sq.shred(seqs(spark, sf_dir), 1000).select(
        F.col("name").alias("qname"), F.lit(5).cast("long").alias("qstart"), F.length("seq").cast("long").alias("qend")
    )
    moved = aln.shift_chunk_coordinates(within)
    return moved.select(aln.strip_chunk_suffix("qname").alias("contig"), "qstart", "qend")


@query("reverse_complement", f"""with {SEQS} select name, reverse(translate(regexp_replace(translate(seq,
  'acgtmrwsykvhdbni', 'ACGTMRWSYKVHDBNI'), '[^ACGTMRWSYKVHDBNI]', '', 'g'), 'ACGTMRWSYKVHDBNI', 'TGCAKYWSRMBDHVNI')) as rc
  from seqs""")
def reverse_complement(spark, sf_dir):
    return seqs(spark, sf_dir).select("name", sc.reverse_complement(F.col("seq")).alias("rc"))


AXIS = """ends as (select tname, max(tend) as extent from {src} group by tname),
  axis as (select tname, row_number() over (order by extent desc, tname) as ref_rank,
    coalesce(sum(extent) over (order by tname rows between unbounded preceding and 1 preceding), 0) as "offset" from ends)"""


@query("dotplot_aggregates", f"""with {PAF},
  q1 as (select * from paf where qname in (select qname from paf group by qname having sum(alen) > 100000) and alen > 10000),
  q2 as (select * from q1 where qname in (select qname from q1 group by qname having sum(alen) > 100000)),
  {AXIS.format(src='q2')},
  per as (select qname, tname, sum(alen) as len, sum(nmatch / alen) as sid, count(*) as n from q2 group by qname, tname),
  main as (select qname, arg_max(p.tname, len * 1000 - ref_rank) as main_target, sum(sid) / sum(n) as mean
    from per p join axis a on p.tname = a.tname group by qname)
  select q.qname, q.tname, strand, case when strand = '-' then qend else qstart end as qs,
    case when strand = '-' then qstart else qend end as qe, tstart, tend, alen,
    cast(tstart + "offset" as bigint) as axis_start, cast(tend + "offset" as bigint) as axis_end,
    cast(ref_rank as int) as ref_rank, main_target, round(nmatch / alen, 6) as identity, round(mean, 6) as mean_identity
  from q2 q join axis a on q.tname = a.tname join main m on m.qname = q.qname where tend - tstart > 12000""")
def dotplot_aggregates(spark, sf_dir):
    rows = pd_.dotplot_rows(paf(spark, sf_dir), min_align=10_000, min_query=100_000, min_span=12_000)
    return rows.withColumns({c: F.round(c, 6) for c in ("identity", "mean_identity")})


@query("window_summary", f"""with {PAF} select count(*) as n, min(tend - tstart) as smallest, max(tend - tstart) as largest,
  median(tend - tstart) as median, round(avg(tend - tstart), 6) as mean from paf""")
def window_summary(spark, sf_dir):
    windows = paf(spark, sf_dir).select(F.col("tstart").alias("start"), F.col("tend").alias("end"))
    return pd_.window_summary(windows).withColumn("mean", F.round("mean", 6))


@query("karyogram_spans", f"""with {PAF} select tname as chr, tstart as "start", tend as "end",
  tstart - greatest(0, 30000 - (tend - tstart + 1)) / 2 as shown_start, tend + greatest(0, 30000 - (tend - tstart + 1)) / 2 as shown_end
  from paf""")
def karyogram_spans(spark, sf_dir):
    windows = paf(spark, sf_dir).select(F.col("tname").alias("chr"), F.col("tstart").alias("start"), F.col("tend").alias("end"))
    return pd_.karyogram_spans(windows, 30_000)


@query("chromosome_order", f"""with {PAF}, named as (select distinct case when tname = 'chr21' then 'chrX' when tname = 'chr20' then 'chrM'
    when tname = 'chr0' then 'CP068270.2' else tname end as raw from paf),
  nice as (select case raw when 'CP068270.2' then 'chr8b' else raw end as chr from named)
  select chr, row_number() over (order by case when regexp_matches(chr, '^chr[0-9]+$') then 0 when chr = 'chrX' then 1
    when chr = 'chrY' then 2 when chr = 'chrMT' then 3 when chr = 'chrM' then 4 else 5 end,
    case when regexp_matches(chr, '^chr[0-9]+$') then cast(substring(chr, 4) as bigint) else 0 end, chr) as place from nice""")
def chromosome_order(spark, sf_dir):
    from pyspark.sql import Window

    tname = F.col("tname")
    raw = F.when(tname == "chr21", "chrX").when(tname == "chr20", "chrM").when(tname == "chr0", "CP068270.2").otherwise(tname)
    nice = F.when(raw == "CP068270.2", F.concat(sc.readable_chromosome(raw), F.lit("b"))).otherwise(raw)
    names = paf(spark, sf_dir).select(nice.alias("chr")).distinct()
    # one row per chromosome name
    w = Window.orderBy(sc.karyotype_rank(F.col("chr")), "chr")
    return names.select("chr", F.row_number().over(w).cast("long").alias("place"))
