"""Liftover queries: one region per order, carried over the line-item alignments."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from chainweave.catalog._registry import query
from chainweave.catalog.views import table
from chainweave.operators import liftover as lo

_ALN = {
    "qname": "concat('ctg', cast(l_suppkey % 20 as string))",
    "qstart": "l_orderkey * 1000 + l_partkey * 5",
    "qend": "l_orderkey * 1000 + l_partkey * 5 + cast(l_quantity as bigint) * 1000",
    "strand": "case when l_returnflag = 'R' then '-' else '+' end",
    "tname": "concat('asm', cast(l_linenumber % 2 as string))",
    "tstart": "l_orderkey * 1000 + l_linenumber * 10",
    "tend": "l_orderkey * 1000 + l_linenumber * 10 + cast(l_quantity as bigint) * 1000",
    "nmatch": "cast(l_quantity as bigint) * 1000 - cast(round(l_discount * 100) as bigint)",
}
_REGION = {
    "region_id": "o_orderkey",
    "seqname": "concat('ctg', cast(o_custkey % 20 as string))",
    "start": "o_orderkey * 1000 + 5000",
    "end": "o_orderkey * 1000 + 5000 + 60000 + (o_custkey % 7) * 10000",
}


def _sql_view(name, columns, source):
    cols = ", ".join(f'{e} as "{n}"' for n, e in columns.items())
    return f"{name} as (select {cols} from {source})"


ALN = _sql_view("aln", _ALN, "lineitem")
REGIONS = _sql_view("regions", _REGION, "orders")
LIFTED = f"""{ALN}, {REGIONS},
  probes as (select region_id, seqname, k as probe_id,
    cast(trunc("start" + ("end" - "start") / 99.0::double * (k - 1)) as bigint) as pos
    from regions, (select cast(unnest(range(1, 101)) as int) as k)),
  binned as (select *, unnest(range(qstart // 65536, qend // 65536 + 1)) as bin from aln),
  ranked as (select p.region_id, p.probe_id, p.pos, a.tname as contig,
    case when strand = '-' then tend - (pos - qstart) else tstart + (pos - qstart) end as coord,
    row_number() over (partition by p.region_id, p.probe_id
      order by nmatch desc, qstart, qend, tname, tstart, tend, strand) as r
    from probes p join binned a on a.qname = p.seqname and a.bin = p.pos // 65536 and p.pos between qstart and qend),
  lifted as (select region_id, probe_id, pos, contig, coord from ranked where r = 1)"""
WINNER = """per_contig as (select region_id, contig, count(*) as n from lifted group by region_id, contig),
  winner as (select region_id, contig, n as n_winner, n_hits from (
    select *, sum(n) over (partition by region_id) as n_hits,
      row_number() over (partition by region_id order by n desc, contig) as r from per_contig) where r = 1 and n_hits > 1),
  onw as (select l.*, n_winner from lifted l join winner w on l.region_id = w.region_id and l.contig = w.contig)"""
RANGE = """m1 as (select *, abs(coord - median(coord) over (partition by region_id)) as far from onw),
  m2 as (select *, median(far) over (partition by region_id) as mad from m1),
  keep as (select * from m2 where case when mad = 0 then far = 0 else 0.6745::double * far / mad < 4 end),
  agg as (select region_id, contig, min(coord) as lift_start, max(coord) as lift_end,
    arg_min(coord, probe_id) as f, arg_max(coord, probe_id) as l, max(pos) - min(pos) as dx,
    min(probe_id) as first_probe, max(probe_id) as last_probe, count(*) as n_kept from keep group by region_id, contig),
  ranged as (select a.region_id, contig, lift_start, lift_end, n_kept, first_probe, last_probe,
    (dx / ("end" - "start")::double > 0.8 and abs(l - f) / ("end" - "start")::double > 1.0::double / 3
     and abs(l - f) / ("end" - "start")::double < 3 and first_probe < 10 and last_probe > 90) as accepted
    from agg a join regions r on a.region_id = r.region_id)"""
EXTRA = """turns as (select *, coalesce(sign(coord - lag(coord) over (partition by region_id order by probe_id)), 0) as turn
    from onw where n_winner >= 10),
  votes as (select region_id, contig, count(*) filter (probe_id <= 6) as nlow, count(*) filter (probe_id >= 94) as nhigh,
    coalesce(sum(turn) filter (probe_id between 2 and 6), 0) as tlow, coalesce(sum(turn) filter (probe_id >= 95), 0) as thigh,
    sum(turn) as tall, median(coord) as mid, (min(pos) + max(pos)) / 2.0::double as xmid from turns group by region_id, contig),
  voted as (select v.*, "start" as s, "end" as e,
    case when nlow = 6 then tlow when nhigh = 7 then thigh else tall end >= 0 as forward
    from votes v join regions r on v.region_id = r.region_id),
  extra as (select region_id, contig, mid - case when forward then xmid - s else e - xmid end as lift_start,
    mid + case when forward then e - xmid else xmid - s end as lift_end, forward from voted)"""


def alignments(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} as {n}" for n, e in _ALN.items()])


def regions(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(*[f"{e} as {n}" for n, e in _REGION.items()])


def winners(spark, sf_dir):
    return lo.on_winner(lo.lift_runs(regions(spark, sf_dir), alignments(spark, sf_dir)))


@query("probe_liftover", f"with {LIFTED} select * from lifted")
def probe_liftover(spark, sf_dir):
    return lo.lift_probes(regions(spark, sf_dir), alignments(spark, sf_dir))


@query("liftover_mad", f"with {LIFTED}, {WINNER}, {RANGE} select * from ranged")
def liftover_mad(spark, sf_dir):
    return lo.lift_by_range(winners(spark, sf_dir))


@query("liftover_extrapolated", f"with {LIFTED}, {WINNER}, {EXTRA} select * from extra")
def liftover_extrapolated(spark, sf_dir):
    return lo.lift_by_extrapolation(winners(spark, sf_dir))


WIDER = "case when e - s < 50000 then 0.25::double when e - s < 200000 then 0.1::double else 0.05::double end * (e - s)"
CONTIGS = "lengths as (select tname as contig, max(tend) as length from aln group by tname)"


def _placed(accepted: str, widen: str, most: str, joined: str) -> str:
    """The found ranges, widened and clamped."""
    return f"""found as (select region_id, contig, lift_start::double as s, lift_end::double as e, 'range' as method from ranged
    where {accepted} union all select region_id, contig, lift_start, lift_end, 'extrapolated' from extra
    where region_id not in (select region_id from ranged where {accepted})),
  wide as (select *, {widen} as d from found),
  placed as (select w.region_id, w.contig, method, cast(trunc(greatest(0.0, s - d)) as bigint) as lift_start,
    cast(trunc(least({most}, e + d - 1)) as bigint) as lift_end from wide w {joined})"""


ON_CONTIG = "join lengths l on w.contig = l.contig"
ON_SOURCE = "join regions g on g.region_id = w.region_id join (select qname, max(qend) as length from aln group by qname) l on l.qname = g.seqname"
ROWS = "select r.region_id, contig, method, lift_start, lift_end from regions r left join placed p on r.region_id = p.region_id"
REFINED = f"{CONTIGS}, {_placed('accepted', WIDER, 'length - 1.0', ON_CONTIG)}"


@query("liftover_regions", f"with {LIFTED}, {WINNER}, {RANGE}, {EXTRA}, {REFINED} {ROWS}")
def liftover_regions(spark, sf_dir):
    alns = alignments(spark, sf_dir)
    lengths = alns.groupBy(F.col("tname").alias("contig")).agg(F.max("tend").alias("length"))
    return lo.lift_regions(regions(spark, sf_dir), alns, lengths)


def _with_source_lengths(alns):
    return alns.join(alns.groupBy("qname").agg(F.max("qend").alias("qlen")), "qname")


@query("liftover_plain", f"with {LIFTED}, {WINNER}, {RANGE}, {EXTRA}, {_placed('true', '0.0', 'length + s - 1', ON_SOURCE)} {ROWS}")
def liftover_plain(spark, sf_dir):
    """Every range counts and none is widened."""
    return lo.lift_regions(regions(spark, sf_dir), _with_source_lengths(alignments(spark, sf_dir)), mode="plain")


@query("liftover_by_median", f"with {LIFTED}, {WINNER}, {RANGE}, {EXTRA}, {_placed('false', '0.0', 'length + s - 1', ON_SOURCE)} {ROWS}")
def liftover_by_median(spark, sf_dir):
    return lo.lift_regions(regions(spark, sf_dir), _with_source_lengths(alignments(spark, sf_dir)), mode="extrapolation")


# a library holds the alignments with exchanged roles, and names that tell what was cut out
_LIBRARY = {
    "qname": "tname", "qstart": "tstart - cut", "qend": "tend - cut", "tname": "qname", "tstart": "qstart", "tend": "qend", "strand": "strand",
    "nmatch": "nmatch",
}


@query("liftover_library", f"with {LIFTED}, {WINNER}, {RANGE}, {EXTRA}, {CONTIGS}, {_placed('true', '0.0', 'length::double', ON_CONTIG)} {ROWS}")
def liftover_library(spark, sf_dir):
    """Rows of a library are put right (extracts moved back, roles exchanged) and lift every region."""
    cut = alignments(spark, sf_dir).withColumn("cut", F.floor(F.col("tstart") / 2))
    stored = cut.select(
        F.expr("concat(tname, ':', cut, '-', cut + 1000, '_x')").alias("qname"),
        *[F.expr(e).alias(n) for n, e in _LIBRARY.items() if n != "qname"],
    )
    return lo.lift_regions(regions(spark, sf_dir), lo.swap_roles(lo.shift_extracted(stored, "qname", "qstart", "qend")), mode="library")


# a second look: each line item aligns a stretch of its order's region to the extract
_SECOND = {
    "region_id": "l_orderkey",
    "qstart": "l_orderkey * 1000 + 5000 + (l_linenumber - 1) * 14000",
    "qend": "l_orderkey * 1000 + 5000 + (l_linenumber - 1) * 14000 + cast(l_quantity as bigint) * 600 + 3000",
    "strand": "case when l_returnflag = 'R' then '-' else '+' end",
    "tstart": "l_linenumber * 9000 - l_partkey % 40 * 500",
    "tend": "l_linenumber * 9000 - l_partkey % 40 * 500 + cast(l_quantity as bigint) * 600 + 3000",
    "nmatch": "cast(l_quantity as bigint) * 600 - cast(round(l_discount * 100) as bigint)",
}


def _again(text: str) -> str:
    """The same rules over the second look's tables."""
    names = "aln regions probes binned ranked lifted per_contig winner onw m1 m2 keep agg ranged turns votes voted extra found wide lengths placed".split()
    return re.sub(rf"\b({'|'.join(names)})\b", r"\1_2", text)


_PROBED = LIFTED[LIFTED.index("probes as"):]


@query("liftover_second_pass", f"""with {LIFTED}, {WINNER}, {RANGE}, {EXTRA}, {REFINED}, {_sql_view("second", _SECOND, "lineitem")},
  firsts as (select r.region_id, contig, method, lift_start, lift_end from regions r left join placed p on r.region_id = p.region_id),
  cuts as (select region_id, contig, greatest(0, cast(trunc(lift_start - (lift_end - lift_start) * 0.02::double) as bigint)) as a,
    cast(trunc(lift_end + (lift_end - lift_start) * 0.02::double) as bigint) as b from firsts where contig is not null),
  inside as (select s.*, contig, a, greatest(tstart, 0) as lo, least(tend, b - a) as hi from second s join cuts c on c.region_id = s.region_id),
  aln_2 as (select concat('r', region_id) as qname, case when strand = '-' then qstart + tend - hi else qstart + lo - tstart end as qstart,
    case when strand = '-' then qstart + tend - lo else qstart + hi - tstart end as qend, strand, concat('r', region_id, '|', contig) as tname,
    a + lo as tstart, a + hi as tend, nmatch from inside where lo <= hi),
  regions_2 as (select r.region_id, concat('r', r.region_id) as seqname, "start", "end" from regions r join cuts c on c.region_id = r.region_id),
  {_again(f"{_PROBED}, {WINNER}, {RANGE}, {EXTRA}, {CONTIGS}, {_placed('true', '0.0', 'length::double', ON_CONTIG)}")}
  select f.region_id, coalesce(split_part(p.contig, '|', 2), f.contig) as contig, coalesce(p.method, f.method) as method,
    coalesce(p.lift_start, f.lift_start) as lift_start, coalesce(p.lift_end, f.lift_end) as lift_end,
    case when p.contig is not null then 2 when f.contig is not null then 1 else 0 end as passes
  from firsts f left join placed_2 p on p.region_id = f.region_id""")
def liftover_second_pass(spark, sf_dir):
    alns = alignments(spark, sf_dir)
    lengths = alns.groupBy(F.col("tname").alias("contig")).agg(F.max("tend").alias("length"))
    first = lo.lift_regions(regions(spark, sf_dir), alns, lengths)
    second = table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} as {n}" for n, e in _SECOND.items()])
    return lo.lift_twice(regions(spark, sf_dir), first, second)


@query("region_cut_alignments", f"""with {LIFTED}, {WINNER}, {RANGE}, {EXTRA}, {REFINED},
  met as (select p.region_id, p.contig, p.lift_start as ls, p.lift_end as le, r."start" as rs, r."end" as re, a.* exclude (bin),
      a.qend - a.qstart as size from placed p join regions r on r.region_id = p.region_id
    join (select *, unnest(range(qstart // 65536, qend // 65536 + 1)) as bin from aln) a on a.qname = r.seqname and a.tname = p.contig
      and a.bin = greatest(a.qstart // 65536, r."start" // 65536) and a.qstart < r."end" and a.qend > r."start"),
  once as (select *, greatest(rs - qstart, 0) as f, greatest(qend - re, 0) as b from met),
  cut1 as (select region_id, contig, ls, le, rs, strand, nmatch, size, qstart + f as qs, qend - b as qe,
    tstart + case when strand = '+' then f else b end as ts, tend - case when strand = '+' then b else f end as te from once),
  twice as (select *, greatest(ls - ts, 0) as f, greatest(te - le, 0) as b from cut1),
  cut2 as (select region_id, contig, ls, rs, strand, nmatch, size, ts + f as ts, te - b as te,
    qs + case when strand = '+' then f else b end as qs, qe - case when strand = '+' then b else f end as qe from twice)
  select region_id, contig as qname, ts - ls as qstart, te - ls as qend, strand, concat('r', region_id) as tname, qs - rs as tstart,
    qe - rs as tend, cast(floor(nmatch * (qe - qs) / size::double) as bigint) as nmatch, qe - qs as alen
  from cut2 where qs < qe and ts < te""")
def region_cut_alignments(spark, sf_dir):
    """What each region's own alignments are, cut out of the assemblies' alignments."""
    from chainweave.plans.alignment import given_alignments

    alns = alignments(spark, sf_dir)
    lengths = alns.groupBy(F.col("tname").alias("contig")).agg(F.max("tend").alias("length"))
    where = regions(spark, sf_dir)
    return given_alignments(where.join(lo.lift_regions(where, alns, lengths), "region_id"), alns)
