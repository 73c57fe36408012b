"""Post-processing queries: result rows made from the line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainweave.catalog._registry import query
from chainweave.catalog.views import table
from chainweave.operators import calls as ca
from chainweave.operators import genotypes as gt
from chainweave.session import materialise

_RESULT = {
    "seqname": "concat('chr', cast(l_orderkey % 7 as string))",
    "start": "cast(floor(l_orderkey / 6) as bigint) * 20000 + (l_linenumber % 3) * 5000",
    "end": "cast(floor(l_orderkey / 6) as bigint) * 20000 + (l_linenumber % 3) * 5000 + 40000 + (l_linenumber % 4) * 10000",
    "sample": "concat('asm_S', cast(l_suppkey % 30 as string), '_hap', cast(1 + l_partkey % 2 as string), case when l_partkey % 11 = 0 then '.alt' else '' end)",
    "res_max": "95 + l_quantity / 10",
    "mut_max": "case l_linenumber % 4 when 0 then 'ref' when 1 then '2_5_inv' when 2 then '1_4_del+2_6_inv' "
    "else '3_7_dup+1_2_del+4_6_inv' end",
    "mut1_start": "{s} + 1000 + (l_partkey % 10) * 500",
    "mut1_end": "{s} + 4000 + (l_partkey % 10) * 700",
    "mut2_start": "case when l_suppkey % 9 > 0 then {s} + 3000 + (l_partkey % 7) * 900 end",
    "mut2_end": "case when l_suppkey % 9 > 0 then {s} + 9000 + (l_partkey % 7) * 900 end",
    "mut3_start": "{s} + 20000 + (l_partkey % 5) * 900",
    "mut3_end": "{s} + 19000 + (l_partkey % 6) * 1900",
}
_S = "(cast(floor(l_orderkey / 6) as bigint) * 20000 + (l_linenumber % 3) * 5000)"
_EXPR = {n: e.format(s=_S) if "{s}" in e else e for n, e in _RESULT.items()}
RES = "res as (select " + ", ".join(f'{e} as "{n}"' for n, e in _EXPR.items()) + " from lineitem)"


def results(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} as {n}" for n, e in _EXPR.items()])
    return rows.withColumn("width_orig", F.col("end") - F.col("start"))


STEPS = """called as (select *, string_split(mut_max, '+') as m from res where res_max > 98 and mut_max <> 'ref'),
  exploded as (select seqname as chr, "start" as src_start, "end" as src_end, unnest(range(1, len(m) + 1)) as step, m,
    mut1_start, mut1_end, mut2_start, mut2_end, mut3_start, mut3_end from called),
  steps as (select chr, case step when 1 then mut1_start when 2 then mut2_start else mut3_start end as "start",
    case step when 1 then mut1_end when 2 then mut2_end else mut3_end end as "end", cast(step as int) as step,
    m[step] as name, src_start, src_end from exploded),
  ok as (select * from steps where "start" is not null and "end" is not null and "end" > "start")"""

WINNERS = """runs as (select *, max("end") over (partition by chr order by "start", "end" rows between unbounded preceding
    and 1 preceding) as reach from ok),
  isl as (select *, sum(case when reach is null or "start" > reach then 1 else 0 end) over (partition by chr
    order by "start", "end" rows unbounded preceding) as island from runs),
  merged as (select chr, island, min("start") as ms, max("end") as me from isl group by chr, island),
  own as (select distinct i.chr, ms, me, src_start, src_end from isl i join merged m on i.chr = m.chr and i.island = m.island),
  refs as (select distinct seqname as chr, "start" as rs, "end" as re from res where res_max < 98),
  sources as (select *, false as ref from own union all
    select distinct o.chr, ms, me, rs, re, true from own o join refs r on o.chr = r.chr and rs < me and ms < re
      and rs >= src_start and re <= src_end),
  ranked as (select *, row_number() over (partition by chr, ms, me order by src_end - src_start, ref, src_start, src_end) as r
    from sources where src_start <= ms and src_end >= me),
  winners as (select chr, ms as "start", me as "end", src_start, src_end from ranked where r = 1)"""


@query("mutation_explode", f"with {RES}, {STEPS} select * from ok")
def mutation_explode(spark, sf_dir):
    return ca.call_steps(results(spark, sf_dir))


@query("source_winner", f"with {RES}, {STEPS}, {WINNERS} select * from winners")
def source_winner(spark, sf_dir):
    rows = results(spark, sf_dir)
    steps = materialise(ca.call_steps(rows))
    return ca.winning_sources(ca.competing_sources(steps, ca.reference_regions(rows)))


@query("dominant_steps", f"""with {RES}, {STEPS}, {WINNERS} select s.* from ok s where exists (select 1 from winners w
  where w.chr = s.chr and w.src_start = s.src_start and w.src_end = s.src_end and s."start" >= w."start" and s."end" <= w."end")""")
def dominant_steps(spark, sf_dir):
    rows = results(spark, sf_dir)
    steps = materialise(ca.with_islands(materialise(ca.call_steps(rows))))
    winners = materialise(ca.winning_sources(ca.competing_sources(steps, ca.reference_regions(rows))))
    return ca.dominant_steps(steps, winners)


# the fold walks the ordered steps one by one, carrying the open interval
@query("dominance_fold", f"""with recursive {RES}, {STEPS}, {WINNERS},
  dom as (select s.* from ok s where exists (select 1 from winners w where w.chr = s.chr and w.src_start = s.src_start
    and w.src_end = s.src_end and s."start" >= w."start" and s."end" <= w."end")),
  seq as (select chr, src_start, "start" as s, "end" as e, regexp_replace(name, '[0-9_:]+', '', 'g') as name,
    row_number() over (partition by chr, src_start order by step, "start", "end", regexp_replace(name, '[0-9_:]+', '', 'g')) as k
    from dom),
  walk as (select chr, src_start, k, s as open_s, e as open_e, 1 as grp, name from seq where k = 1
    union all
    select n.chr, n.src_start, n.k, case when n.s < w.open_e and n.e > w.open_s then w.open_s else n.s end,
      case when n.s < w.open_e and n.e > w.open_s then greatest(w.open_e, n.e) else n.e end,
      case when n.s < w.open_e and n.e > w.open_s then w.grp else w.grp + 1 end, n.name
    from walk w join seq n on n.chr = w.chr and n.src_start = w.src_start and n.k = w.k + 1)
  select chr, min(open_s) as "start", max(open_e) as "end", string_agg(name, '+' order by k) as name
  from walk group by chr, src_start, grp""")
def dominance_fold(spark, sf_dir):
    return ca.regional_dominance(results(spark, sf_dir))


HAPLOTYPES = """named as (select seqname, "start", "end", "end" - "start" as width_orig,
    regexp_replace(sample, '^[^_]+_([^\\._]+).*', '\\1') as sample_id,
    case when regexp_matches(sample, 'h[ap]{0,2}2') then 2 else 1 end as phase,
    regexp_replace(case when res_max < 98 then 'UNK' else mut_max end, '[0-9_:]+', '', 'g') as mutation from res
    where not regexp_matches(sample, '\\.alt$')),
  calls as (select distinct seqname, "start", "end", sample_id, phase, mutation as call from named),
  muts as (select seqname, "start", "end", mutation, max(width_orig) as width_orig from named
    where mutation not in ('ref', 'UNK', '.') group by all),
  haps as (select sample_id, phase from (select distinct sample_id from named), (values (1), (2)) p(phase)),
  codes as (select m.seqname, m."start", m."end", m.mutation, m.width_orig, h.sample_id, h.phase,
    coalesce(max(case when c.call = m.mutation then 2 when c.call <> 'UNK' then 1 else 0 end), 0) as code
    from muts m cross join haps h left join calls c on c.seqname = m.seqname and c."start" = m."start" and c."end" = m."end"
      and c.sample_id = h.sample_id and c.phase = h.phase group by all),
  gts as (select seqname, "start", "end", mutation, width_orig, sample_id,
    string_agg(['.', '0', '1'][code + 1], '|' order by phase) as gt,
    case when count(*) filter (code = 2) = 1 then cast("start" as varchar) else '.' end as ps from codes
    group by seqname, "start", "end", mutation, width_orig, sample_id)"""


@query("vcf_genotypes", f"with {RES}, {HAPLOTYPES} select * from gts")
def vcf_genotypes(spark, sf_dir):
    return gt.genotypes(gt.haplotype_calls(results(spark, sf_dir)))


@query("vcf_records", f"""with {RES}, {HAPLOTYPES},
  wide as (select seqname, "start", "end", mutation, width_orig,
    string_agg(sample_id || '=' || gt || ':' || ps, ' ' order by sample_id) as calls
    from gts group by seqname, "start", "end", mutation, width_orig)
  select seqname as "CHROM", "start" as "POS", concat('<SV.', mutation, '_', seqname, '-', "start", '-', "end", '>') as "ID",
    'N' as "REF", concat('<', mutation, '>') as "ALT", '.' as "QUAL", 'PASS' as "FILTER",
    concat('SVTYPE=', mutation, ';SVDEPTH=', len(string_split(mutation, '+')), ';SVLEN=', width_orig, ';END=', "end") as "INFO",
    'GT:PS' as "FORMAT", calls from wide""")
def vcf_records(spark, sf_dir):
    records = gt.called_records(gt.haplotype_calls(results(spark, sf_dir)))
    shown = F.array_join(F.transform("calls", lambda c: F.concat_ws("=", c["sample"], c["call"])), " ")
    return records.withColumn("calls", shown)


@query("absolute_steps", """with w as (select l_orderkey, l_linenumber, l_partkey % 9 + 1 as s1, l_partkey % 9 + 3 + l_suppkey % 5 as e1,
    l_suppkey % 11 + 1 as s2, l_suppkey % 11 + 2 + l_partkey % 6 as e2, case l_linenumber % 3 when 0 then 'inv' when 1 then 'del' else 'dup' end as k
    from lineitem),
  m as (select *, case when k = 'inv' and s2 > s1 and s2 < e1 then e1 - (s2 - s1) when k = 'del' and s2 > s1 then s2 + e1 - s1
      when k = 'dup' and s2 > e1 then s2 - (e1 - s1) else s2 end as ns,
    case when k = 'inv' and e2 > s1 and e2 < e1 then e1 - (e2 - s1) when k = 'del' and e2 > s1 then e2 + e1 - s1
      when k = 'dup' and e2 > e1 then e2 - (e1 - s1) else e2 end as ne from w)
  select l_orderkey, l_linenumber, concat(s1, '_', e1, '_', k, '+', s2, '_', e2, '_del') as chain,
    concat(s1, '_', e1, '_', k, '+', case when k = 'inv' then least(ns, ne) else ns end, '_',
      case when k = 'inv' then greatest(ns, ne) else ne end, '_del') as absolute from m""")
def absolute_steps(spark, sf_dir):
    from chainweave.functions import scalars as sc

    kind = F.element_at(F.array(F.lit("inv"), F.lit("del"), F.lit("dup")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    chain = F.concat_ws(
        "+", F.concat_ws("_", (p % 9 + 1).cast("string"), (p % 9 + 3 + s % 5).cast("string"), kind),
        F.concat_ws("_", (s % 11 + 1).cast("string"), (s % 11 + 2 + p % 6).cast("string"), F.lit("del")),
    )
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", chain.alias("chain"))
    absolute = sc.mutation_name(sc.absolute_steps(sc.mutation_steps(F.col("chain"))))
    return rows.withColumn("absolute", absolute)
