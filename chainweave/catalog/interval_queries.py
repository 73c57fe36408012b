"""Queries on intervals: the target spans of all alignments, and spans made from the orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainweave.catalog._registry import query
from chainweave.catalog.views import PAF, SPAN_GENOME, SPANS, paf, rivals, rivals_sql, span_genome, spans, table
from chainweave.operators import intervals as iv

WIDE, NARROW = 200_000, 3_000
B_WIDE, B_NARROW = rivals_sql("b", WIDE), rivals_sql("b", NARROW)

ISLANDS = """runs as (select *, max("end") over (partition by chr order by "start", "end"
    rows between unbounded preceding and 1 preceding) as reach from {src}),
  isl as (select *, sum(case when reach is null or "start" > reach + {d} then 1 else 0 end)
    over (partition by chr order by "start", "end" rows unbounded preceding) as island from runs)"""


@query("merge_intervals", f"""with {PAF}, {SPANS}, {ISLANDS.format(src='a', d=500)}
  select chr, min("start") as "start", max("end") as "end", count(*) as members from isl group by chr, island""")
def merge_intervals(spark, sf_dir):
    return iv.merge(spans(spark, sf_dir), distance=500)


@query("merge_members", f"""with {PAF},
  a as (select tname || '_' || qname as chr, tstart as "start", tend as "end", strand from paf), {ISLANDS.format(src='a', d=500)}
  select distinct chr, min("start") over (partition by chr, island) as "start", strand from isl""")
def merge_members(spark, sf_dir):
    rows = paf(spark, sf_dir).select(
        F.concat_ws("_", "tname", "qname").alias("chr"), F.col("tstart").alias("start"), F.col("tend").alias("end"), "strand"
    )
    return iv.merge_members(rows, "strand", distance=500)


@query("cluster_topk", f"""with {PAF}, {SPANS.replace('a as', 'raw as', 1)}, a as (select distinct * from raw),
  {ISLANDS.format(src='a', d=2000)},
  ranked as (select *, min("start") over (partition by chr, island) as cluster,
    row_number() over (partition by chr, island order by "end" - "start" desc, "start" desc, "end" desc) as r from isl)
  select chr, "start", "end", cluster from ranked where r <= 3""")
def cluster_topk(spark, sf_dir):
    rows = spans(spark, sf_dir).distinct()
    return iv.top_per_cluster(iv.cluster(rows, distance=2000), 3).select("chr", "start", "end", "cluster")


@query("slop_clamped", f"""with {PAF}, {SPANS}, {SPAN_GENOME}
  select a.chr, greatest(0, "start" - 50000) as "start", least(length, "end" + 50000) as "end"
  from a join genome g on a.chr = g.chr""")
def slop_clamped(spark, sf_dir):
    return iv.pad(spans(spark, sf_dir), span_genome(spark, sf_dir), 50_000).select("chr", "start", "end")


@query("slop_share", f"""with {PAF}, {SPANS}, {SPAN_GENOME},
  w as (select *, cast(trunc(0.75 * ("end" - "start")) as bigint) as d from a)
  select w.chr, greatest(0, "start" - d) as "start", least(length, "end" + d) as "end" from w join genome g on w.chr = g.chr""")
def slop_share(spark, sf_dir):
    return iv.pad_by_share(spans(spark, sf_dir), span_genome(spark, sf_dir), 0.75).select("chr", "start", "end")


@query("enlarge_by_factor", f"""with {PAF}, {SPANS}, {SPAN_GENOME},
  w as (select a.*, length, cast(round_even("start" - ("end" - "start") * 0.5 / 2, 0) as bigint) as s,
    cast(round_even("end" + ("end" - "start") * 0.5 / 2, 0) as bigint) as e from a join genome g on a.chr = g.chr)
  select chr, "start", "end", greatest(s, 0) as start_pad, least(e, length) as end_pad, (s < 0 or e > length) as exceeds_x
  from w""")
def enlarge_by_factor(spark, sf_dir):
    rows = spans(spark, sf_dir).join(span_genome(spark, sf_dir), "chr")
    return iv.enlarge(rows, 1.5, F.col("length")).drop("length")


@query("split_windows", f"""with {PAF}, {SPANS},
  cut as (select chr, "end" as e, "start" as s0, unnest(case when "end" - "start" > 20000
    then range("start", "end", 8000) else [ "start" ] end) as s from a)
  select chr, s as "start", case when e - s0 > 20000 then least(s + 20000, e) else e end as "end" from cut""")
def split_windows(spark, sf_dir):
    return iv.split_windows(spans(spark, sf_dir), 20_000, 12_000)


@query("intersect_clip", f"""with {PAF}, {SPANS}, {B_WIDE}
  select a.chr, greatest(a."start", b."start") as "start", least(a."end", b."end") as "end"
  from a join b on a.chr = b.chr and a."start" < b."end" and b."start" < a."end" """)
def intersect_clip(spark, sf_dir):
    return iv.clip_intersect(spans(spark, sf_dir), rivals(spark, sf_dir, WIDE))


@query("anti_overlap_fraction", f"""with {PAF}, {SPANS}, {B_NARROW}
  select a.* from a where not exists (select 1 from b where a.chr = b.chr and a."start" < b."end" and b."start" < a."end"
    and least(a."end", b."end") - greatest(a."start", b."start") >= 0.5 * (b."end" - b."start"))""")
def anti_overlap_fraction(spark, sf_dir):
    return iv.without_covered(spans(spark, sf_dir), rivals(spark, sf_dir, NARROW), 0.5)


@query("subtract_intervals", f"""with {PAF}, {SPANS}, {B_NARROW}, {ISLANDS.format(src='b', d=0)},
  m as (select chr, min("start") as s, max("end") as e from isl group by chr, island),
  g as (select chr, coalesce(lag(e) over w, -1) as s, s as e from m window w as (partition by chr order by s)
    union all select chr, max(e), cast(1e15 as bigint) from m group by chr)
  select a.chr, greatest(a."start", g.s) as "start", least(a."end", g.e) as "end" from a join g on a.chr = g.chr
    and a."start" < g.e and g.s < a."end"
  union all select * from a where chr not in (select chr from m)""")
def subtract_intervals(spark, sf_dir):
    return iv.subtract(spans(spark, sf_dir), rivals(spark, sf_dir, NARROW))


_RECIPROCAL = """with {paf}, {a}, d as (select distinct * from a)
  select distinct x.chr, min(y."start") as "start", max(y."end") as "end" from d x join d y on x.chr = y.chr
    and x."start" < y."end" and y."start" < x."end"
    and least(x."end", y."end") - greatest(x."start", y."start") >= 0.75 * (x."end" - x."start")
    and least(x."end", y."end") - greatest(x."start", y."start") >= 0.75 * (y."end" - y."start")
  group by x.chr, x."start", x."end" """


@query("reciprocal_merge_round", _RECIPROCAL.format(paf=PAF, a=SPANS))
def reciprocal_merge_round(spark, sf_dir):
    return iv.reciprocal_round(spans(spark, sf_dir))


def _fixpoint_sql(rounds: int) -> str:
    step = """r{k} as (select distinct x.chr, min(y."start") as "start", max(y."end") as "end" from r{j} x join r{j} y
      on x.chr = y.chr and x."start" < y."end" and y."start" < x."end"
      and least(x."end", y."end") - greatest(x."start", y."start") >= 0.75 * (x."end" - x."start")
      and least(x."end", y."end") - greatest(x."start", y."start") >= 0.75 * (y."end" - y."start")
      group by x.chr, x."start", x."end")"""
    steps = ", ".join(step.format(k=k, j=k - 1) for k in range(1, rounds + 1))
    return f"with {PAF}, {SPANS}, r0 as (select distinct * from a), {steps} select * from r{rounds}"


@query("reciprocal_merge_fixpoint", _fixpoint_sql(10))
def reciprocal_merge_fixpoint(spark, sf_dir):
    return iv.reciprocal_merge(spans(spark, sf_dir))


@query("annotation_overlap", f"""with ann as (select concat('chr', cast(p_partkey % 22 as string)) as chr, p_name as name,
    p_partkey * 5000 as "start", p_partkey * 5000 + p_size * 400 as "end" from part), {PAF},
  w as (select distinct tname as chr, tstart as ws, tend as we from paf)
  select a.chr, name, a."start", a."end", ws as win_start, we as win_end, greatest(a."start", ws) as shown_start,
    least(a."end", we) as shown_end from ann a join w on a.chr = w.chr and
    ((a."start" > ws and a."start" < we) or (a."end" > ws and a."end" < we) or (a."start" < ws and a."end" > we))""")
def annotation_overlap(spark, sf_dir):
    genes = table(spark, sf_dir, "part").select(
        F.concat(F.lit("chr"), (F.col("p_partkey") % 22).cast("string")).alias("chr"),
        F.col("p_name").alias("name"),
        (F.col("p_partkey") * 5000).alias("start"),
        (F.col("p_partkey") * 5000 + F.col("p_size") * 400).alias("end"),
    )
    windows = paf(spark, sf_dir).select(
        F.col("tname").alias("chr"), F.col("tstart").alias("win_start"), F.col("tend").alias("win_end")
    ).distinct()
    return iv.touching_window(genes, windows)


@query("union_tiers", f"""with {PAF}, {SPANS}, {B_NARROW}
  select * from b union all select a.* from a where not exists (select 1 from b where b.chr = a.chr
    and a."start" < b."end" and b."start" < a."end"
    and least(a."end", b."end") - greatest(a."start", b."start") >= 0.25 * (b."end" - b."start"))""")
def union_tiers(spark, sf_dir):
    first, second = rivals(spark, sf_dir, NARROW), spans(spark, sf_dir)
    return first.unionByName(iv.without_covered(second, first, 0.25))
