"""Grid queries: block cells from the events, alignment grids from the orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainweave.catalog._registry import query
from chainweave.catalog.views import CELLS, GRID_PAF, cells, grid_paf
from chainweave.operators import alignments as aln
from chainweave.operators import grid as g

N = 12
GRID = f"""{CELLS}, grid as (select region_id, x, y, case when min(z) = max(z) then max(z) else 0 end as z
    from cells group by region_id, x, y),
  nz as (select * from grid where z <> 0),
  dim as (select distinct region_id, 12 as nx, 12 as ny, 1980 as sum_x, 1020 + region_id % 7 * 120 as sum_y from cells)"""
XS = list(range(1, N + 1))


def block_lengths(spark, sf_dir):
    """Twelve blocks per axis; y-blocks differ by region."""
    regions = cells(spark, sf_dir).select("region_id").distinct()
    axes = F.explode(F.array(F.lit("x"), F.lit("y")))
    return (
        regions.withColumn("axis", axes).withColumn("idx", F.explode(F.expr(f"sequence(1L, {N}L)")))
        .withColumn(
            "length",
            F.when(F.col("axis") == "x", 100 + 10 * F.col("idx"))
            .otherwise(20 + 10 * F.col("idx") + F.col("region_id") % 7 * 10),
        )
    )


def grid(spark, sf_dir):
    return g.resolve_conflicts(cells(spark, sf_dir))


@query("grid_dedupe", f"with {GRID} select * from grid")
def grid_dedupe(spark, sf_dir):
    return grid(spark, sf_dir)


PIVOT = ", ".join(f"coalesce(max(z) filter (x = {x}), 0) as x{x}" for x in XS)


@query("grid_pivot", f"""with {GRID}, ys as (select region_id, unnest(range(1, 13)) as y from dim)
  select s.region_id, s.y, {PIVOT} from ys s left join grid c on c.region_id = s.region_id and c.y = s.y
  group by s.region_id, s.y""")
def grid_pivot(spark, sf_dir):
    return g.pivot(grid(spark, sf_dir), block_lengths(spark, sf_dir), XS)


@query("grid_unpivot", f"with {GRID} select * from nz")
def grid_unpivot(spark, sf_dir):
    return g.unpivot(g.pivot(grid(spark, sf_dir), block_lengths(spark, sf_dir), XS), XS)


VOTE = """vote as (select region_id, coalesce(sum(z) filter (z > 0), 0) as forward,
    coalesce(-sum(z) filter (z < 0), 0) as reverse from nz
    where not (x between 3 and 9) and not (y between 3 and 9) group by region_id),
  voted as (select d.region_id, ny, cast(coalesce(forward, 0) as bigint) as forward,
    cast(coalesce(reverse, 0) as bigint) as reverse from dim d left join vote v on v.region_id = d.region_id)"""


@query("grid_flip_vote", f"""with {GRID}, {VOTE} select *, reverse > forward as flip,
  not (least(forward, reverse) = 0 or greatest(forward, reverse) >= 2 * least(forward, reverse)) as flip_unsure
  from (select region_id, cast(ny as bigint) as ny, forward, reverse from voted)""")
def grid_flip_vote(spark, sf_dir):
    return g.frame_vote(grid(spark, sf_dir), g.dims(block_lengths(spark, sf_dir)))


@query("grid_flip", f"""with {GRID}, {VOTE} select c.region_id, x, case when reverse > forward then 13 - y else y end as y,
  case when reverse > forward then -z else z end as z from grid c join voted v on v.region_id = c.region_id""")
def grid_flip(spark, sf_dir):
    cell = grid(spark, sf_dir)
    return g.flip_where_voted(cell, g.frame_vote(cell, g.dims(block_lengths(spark, sf_dir))))


@query("grid_clutter", f"""with {GRID}, t as (select region_id,
    count(*) filter (y = 1 and x between 2 and 11) as first_row, count(*) filter (y = 12 and x between 2 and 11) as last_row,
    count(*) filter (x = 1 and y between 2 and 11) as first_col, count(*) filter (x = 12 and y between 2 and 11) as last_col
    from nz group by region_id)
  select d.region_id, coalesce(first_row, 0) as first_row, coalesce(last_row, 0) as last_row,
    coalesce(first_col, 0) as first_col, coalesce(last_col, 0) as last_col,
    coalesce(greatest(first_row, last_row, first_col, last_col), 0) >= 5 as cluttered
  from dim d left join t on t.region_id = d.region_id""")
def grid_clutter(spark, sf_dir):
    return g.border_clutter(grid(spark, sf_dir), g.dims(block_lengths(spark, sf_dir)))


@query("estimated_score", f"""with {GRID}, near as (select * from nz where abs(y - x) < 3),
  r as (select region_id, y, greatest(max(z), 0) as m from near group by region_id, y),
  c as (select region_id, x, greatest(max(z), 0) as m from near group by region_id, x),
  rs as (select region_id, sum(m) as m from r group by region_id), cs as (select region_id, sum(m) as m from c group by region_id)
  select d.region_id, round((coalesce(rs.m, 0) + coalesce(cs.m, 0)) / (sum_x + sum_y)::double * 100, 4) as estimate
  from dim d left join rs on rs.region_id = d.region_id left join cs on cs.region_id = d.region_id""")
def estimated_score(spark, sf_dir):
    scored = g.estimated_score(grid(spark, sf_dir), g.dims(block_lengths(spark, sf_dir)))
    return scored.withColumn("estimate", F.round("estimate", 4))


@query("symmetry", f"""with {GRID} select region_id, round(least(sum_x, sum_y) / greatest(sum_x, sum_y)::double, 6) as symmetry,
  not (least(sum_x, sum_y) / greatest(sum_x, sum_y)::double < 0.8 and ny > 5) as go_on from dim""")
def symmetry(spark, sf_dir):
    out = g.symmetry(g.dims(block_lengths(spark, sf_dir)))
    return out.withColumn("symmetry", F.round("symmetry", 6))


PAIRS = """pairs as (select a.region_id, a.x as p1, b.x as p2, bool_or(sign(a.z) = sign(b.z)) as dupdel,
    bool_or(sign(a.z) <> sign(b.z)) as inv from nz a join nz b on a.region_id = b.region_id and a.y = b.y and a.x < b.x
    group by a.region_id, a.x, b.x)"""
OPPORTUNITIES = f"""{PAIRS}, moves as (select region_id, p1, p2, 'del' as sv from pairs where dupdel
    union all select region_id, p1, p2, 'dup' from pairs where dupdel
    union all select region_id, p1, p2, 'inv' from pairs where inv and p2 - p1 > 1)"""


@query("sv_opportunities", f"with {GRID}, {OPPORTUNITIES} select * from moves")
def sv_opportunities(spark, sf_dir):
    return g.opportunities(grid(spark, sf_dir))


@query("trim_rows", f"""with {GRID} select region_id, x, y - min(y) over (partition by region_id) + 1 as y, z from nz""")
def trim_rows(spark, sf_dir):
    return g.trim_rows(grid(spark, sf_dir))


LINES = f"""{GRID_PAF}, o as (select region_id, tstart, tend, case when strand = '-' then qend else qstart end as qs,
    case when strand = '-' then qstart else qend end as qe, case when strand = '-' then -1 else 1 end as m from gpaf),
  lines as (select region_id, 'x' as axis, tstart as pos from o union select region_id, 'x', tend from o
    union select region_id, 'y', qs from o union select region_id, 'y', qe from o
    union select l.region_id, case when l.axis = 'x' then 'y' else 'x' end,
      case when l.axis = 'x' then qs + m * (pos - tstart) else tstart + m * (pos - qs) end
    from lines l join o on l.region_id = o.region_id and ((l.axis = 'x' and pos > tstart and pos < tend)
      or (l.axis = 'y' and pos > least(qs, qe) and pos < greatest(qs, qe))))"""
BLOCKS = """blocks as (select * from (select region_id, axis, row_number() over w as idx, pos, lead(pos) over w - pos as length
    from lines window w as (partition by region_id, axis order by pos)) where length is not null)"""


def _lines(spark, sf_dir):
    alns = aln.orient(grid_paf(spark, sf_dir))
    return alns, g.gridlines(alns)


@query("gridlines_fixpoint", f"with recursive {LINES} select * from lines")
def gridlines_fixpoint(spark, sf_dir):
    return _lines(spark, sf_dir)[1]


@query("grid_blocks", f"with recursive {LINES}, {BLOCKS} select * from blocks")
def grid_blocks(spark, sf_dir):
    return g.blocks(_lines(spark, sf_dir)[1])


# the oracle walks each alignment over the lines inside it, block by block on both axes
@query("rasterise", f"""with recursive {LINES}, {BLOCKS},
  xb as (select o.*, b.idx as x, b.pos - tstart as off, b.length as dx from o join blocks b on b.region_id = o.region_id
    and b.axis = 'x' and b.pos >= tstart and b.pos + b.length <= tend),
  yb as (select o.*, b.idx as y, b.length as dy, case when m = 1 then b.pos - qs else qs - b.pos - b.length end as off
    from o join blocks b on b.region_id = o.region_id and b.axis = 'y' and b.pos >= least(qs, qe)
    and b.pos + b.length <= greatest(qs, qe))
  select distinct xb.region_id, x, y, xb.m * dx as z from xb join yb on xb.region_id = yb.region_id and xb.tstart = yb.tstart
    and xb.tend = yb.tend and xb.qs = yb.qs and xb.qe = yb.qe and xb.off = yb.off""")
def rasterise(spark, sf_dir):
    alns, lines = _lines(spark, sf_dir)
    return g.rasterise(alns, g.blocks(lines)).distinct()
