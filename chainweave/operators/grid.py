"""Sparse signed grids: gridlines, rasterised alignments, and the questions asked of the block matrix.

A region's grid is bounded (150 alignments, 250 lines; larger ones are coarsened first), regions are many.
Everything below handles all regions in one job, keyed by ``region_id``. Cells are ``(region_id, x, y, z)``
with 1-based block numbers and z the signed block length; blocks are ``(region_id, axis, idx, length)``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainweave.session import materialise

KEY = "region_id"
#: Alignments and lines of a region up to which its lines are found in one row, and rounds of that.
MANY_ALIGNMENTS, MANY_LINES = 500, 5_000
ROUNDS = 32


def _project(lines: DataFrame, alns: DataFrame) -> DataFrame:
    """Carry lines over every alignment they cross strictly inside, to the other axis."""
    on = lines.join(alns, KEY)
    slope = F.when(F.col("qe") >= F.col("qs"), 1).otherwise(-1)
    pos = F.col("pos")
    from_x = (F.col("axis") == "x") & (pos > F.col("tstart")) & (pos < F.col("tend"))
    from_y = (F.col("axis") == "y") & (pos > F.least("qs", "qe")) & (pos < F.greatest("qs", "qe"))
    return (
        on.where(from_x | from_y)
        .select(
            KEY,
            F.when(F.col("axis") == "x", "y").otherwise("x").alias("axis"),
            F.when(F.col("axis") == "x", F.col("qs") + slope * (pos - F.col("tstart")))
            .otherwise(F.col("tstart") + slope * (pos - F.col("qs"))).alias("pos"),
        )
        .distinct()
    )


def gridlines(
    alns: DataFrame, zero_line: bool = False, max_rounds: int = 100_000, limit: int | None = None
) -> DataFrame:
    """All lines reached from alignment ends by carrying them over the alignments: ``(region_id, axis, pos)``.

    ``alns`` has region_id, tstart, tend and oriented qs, qe with slope 1 or -1. Only lines found in the last round
    are carried on. With ``zero_line`` an axis on which a round lands nowhere gets the line 0. With ``limit`` a
    region that has more lines is not carried on (the caller coarsens it and asks again).

    A region's lines are found in one row of its alignments and lines, round by round. Regions with very many of either, or that need very many
    rounds, go on by joins.
    """
    alns = materialise(alns.select(KEY, "tstart", "tend", "qs", "qe"))
    crowded = materialise(alns.groupBy(KEY).count().where(F.col("count") > MANY_ALIGNMENTS).select(KEY))
    few = alns if crowded.isEmpty() else alns.join(crowded, KEY, "left_anti")
    rounds = min(ROUNDS, max_rounds)
    whole = few.groupBy(KEY).agg(F.collect_set(F.struct("tstart", "tend", "qs", "qe")).alias("alns"))
    found = materialise(whole.select(KEY, F.inline(F.array(_lines_of_region(F.col("alns"), zero_line, limit, rounds)))))
    known = found.select(KEY, F.inline("known"))
    unfinished = materialise(found.where(F.size("frontier") > 0).select(KEY).unionByName(crowded))
    if unfinished.isEmpty():
        return known
    rest = materialise(alns.join(unfinished, KEY, "left_semi").distinct())
    ends = rest.join(crowded, KEY, "left_semi").select(KEY, F.inline(_ends(F.struct("tstart", "tend", "qs", "qe")))).distinct()
    reached = materialise(known.join(unfinished, KEY, "left_semi").unionByName(ends))
    frontier = materialise(found.select(KEY, F.inline("frontier")).unionByName(ends))
    more = _carry_on(rest, reached, frontier, zero_line, max_rounds - rounds, limit)
    return known.join(unfinished, KEY, "left_anti").unionByName(more)


def _ends(a: Column) -> Column:
    """The lines at an alignment's own ends."""
    return F.array(*[
        F.struct(F.lit(axis).alias("axis"), a[c].cast("long").alias("pos")) for axis, c in (("x", "tstart"), ("x", "tend"), ("y", "qs"), ("y", "qe"))
    ])


def _lines_of_region(alns: Column, zero_line: bool, limit: int | None, rounds: int) -> Column:
    """``known`` and ``frontier`` of a region after so many rounds; a frontier is left where they were too few or the lines too many."""

    def carried(line: Column) -> Column:
        on_x, pos = line["axis"] == "x", line["pos"]

        def crossed(a: Column) -> Column:
            in_y = (pos > F.least(a["qs"], a["qe"])) & (pos < F.greatest(a["qs"], a["qe"]))
            return F.when(on_x, (pos > a["tstart"]) & (pos < a["tend"])).otherwise(in_y)

        def landed(a: Column) -> Column:
            slope = F.when(a["qe"] >= a["qs"], 1).otherwise(-1)
            to = F.when(on_x, a["qs"] + slope * (pos - a["tstart"])).otherwise(a["tstart"] + slope * (pos - a["qs"]))
            return F.struct(F.when(on_x, "y").otherwise("x").alias("axis"), to.cast("long").alias("pos"))

        return F.transform(F.filter(alns, crossed), landed)

    def zero(landed: Column, axis: str) -> Column:
        silent = ~F.exists(landed, lambda line: line["axis"] == axis)
        return F.filter(F.array(F.struct(F.lit(axis).alias("axis"), F.lit(0).cast("long").alias("pos"))), lambda _: silent)

    def grown(state: Column) -> Column:
        landed = F.flatten(F.transform(state["frontier"], carried))
        if zero_line:
            landed = _let(landed, lambda lines: F.concat(lines, zero(lines, "x"), zero(lines, "y")))
        ahead = lambda known, new: new if limit is None else F.filter(new, lambda _: F.size(known) <= limit)
        return _let(F.array_except(landed, state["known"]), lambda new: _let(
            F.concat(state["known"], new), lambda known: F.struct(known.alias("known"), ahead(known, new).alias("frontier"))
        ))

    def step(state: Column, _: Column) -> Column:
        go = (F.size(state["frontier"]) > 0) & (F.size(state["known"]) <= MANY_LINES)
        return F.when(go, grown(state)).otherwise(state)

    start = F.array_distinct(F.flatten(F.transform(alns, _ends)))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(start.alias("known"), start.alias("frontier")), step)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _carry_on(alns: DataFrame, known: DataFrame, frontier: DataFrame, zero_line: bool, max_rounds: int, limit: int | None) -> DataFrame:
    """Round by round, all regions at once by joins."""
    for _ in range(max_rounds):
        landed = _project(frontier, alns)
        if zero_line:
            axes = F.array(F.lit("x"), F.lit("y"))
            silent = frontier.select(KEY).distinct().withColumn("axis", F.explode(axes)).join(
                landed.select(KEY, "axis").distinct(), [KEY, "axis"], "left_anti"
            )
            landed = landed.unionByName(silent.withColumn("pos", F.lit(0).cast("long"))).distinct()
        new = materialise(landed.join(known, [KEY, "axis", "pos"], "left_anti"))
        if new.isEmpty():
            break
        known = known.unionByName(new)  # every part is a written table, so this stays a plain scan
        frontier = new
        if limit is not None:
            full = known.groupBy(KEY).count().where(F.col("count") > limit)
            frontier = materialise(new.join(full, KEY, "left_anti"))
    return known


def unconverged(lines: DataFrame, alns: DataFrame) -> DataFrame:
    """``region_id`` of regions in which an alignment carries some line to a place that has none."""
    alns = alns.select(KEY, "tstart", "tend", "qs", "qe").distinct()
    return _project(lines, alns).join(lines, [KEY, "axis", "pos"], "left_anti").select(KEY).distinct()


def blocks(lines: DataFrame) -> DataFrame:
    """Blocks between neighbouring lines: ``(region_id, axis, idx, pos, length)``, idx from 1."""
    w = Window.partitionBy(KEY, "axis").orderBy("pos")
    # dealt by region, so that what goes on by region needs no other shuffle
    return (
        lines.repartition(KEY).withColumns({"idx": F.row_number().over(w).cast("long"), "length": F.lead("pos").over(w) - F.col("pos")})
        .where("length is not null")
        .select(KEY, "axis", "idx", "pos", "length")
    )


def rasterise(alns: DataFrame, block: DataFrame) -> DataFrame:
    """Cells an alignment runs through. On a converged grid each x-block it spans maps to exactly one y-block:
    the one whose lower edge (upper edge on the minus strand) the alignment meets there."""
    xs = block.where("axis = 'x'").select(KEY, F.col("idx").alias("x"), F.col("pos").alias("x0"), F.col("length").alias("dx"))
    ys = block.where("axis = 'y'").select(KEY, F.col("idx").alias("y"), F.col("pos").alias("y0"), F.col("length").alias("dy"))
    plus = F.col("qe") >= F.col("qs")
    into = F.col("x0") - F.col("tstart")
    on_x = (
        alns.select(KEY, "tstart", "tend", "qs", "qe").distinct().join(xs, KEY)
        .where("tstart <= x0 and x0 + dx <= tend")
        .select(
            KEY, "x",
            F.when(plus, F.col("qs") + into).otherwise(F.col("qs") - into - F.col("dx")).alias("y0"),
            F.when(plus, F.col("dx")).otherwise(-F.col("dx")).alias("z"),
        )
    )
    return on_x.join(ys, [KEY, "y0"]).select(KEY, "x", "y", "z")


def resolve_conflicts(cells: DataFrame) -> DataFrame:
    """One value per cell; cells with differing values become 0."""
    return cells.groupBy(KEY, "x", "y").agg(
        F.when(F.min("z") == F.max("z"), F.max("z")).otherwise(F.lit(0).cast("long")).alias("z")
    )


def dims(block: DataFrame) -> DataFrame:
    """Per region: number of blocks and summed length on both axes."""
    return block.groupBy(KEY).agg(
        F.count_if(F.col("axis") == "x").alias("nx"), F.count_if(F.col("axis") == "y").alias("ny"),
        F.sum(F.when(F.col("axis") == "x", F.col("length")).otherwise(0)).alias("sum_x"),
        F.sum(F.when(F.col("axis") == "y", F.col("length")).otherwise(0)).alias("sum_y"),
    )


def pivot(cells: DataFrame, block: DataFrame, columns: list[int]) -> DataFrame:
    """Dense rows: one column per x-block in ``columns``, every y-block present, empty cells 0."""
    values = [F.coalesce(F.max(F.when(F.col("x") == x, F.col("z"))), F.lit(0).cast("long")).alias(f"x{x}") for x in columns]
    rows = block.where("axis = 'y'").select(KEY, F.col("idx").alias("y"))
    return rows.join(cells, [KEY, "y"], "left").groupBy(KEY, "y").agg(*values)


def unpivot(dense: DataFrame, columns: list[int]) -> DataFrame:
    """Dense rows back to non-zero cells."""
    long = dense.unpivot([KEY, "y"], [f"x{x}" for x in columns], "name", "z")
    return long.where("z <> 0").select(KEY, F.substring("name", 2, 9).cast("long").alias("x"), "y", "z")


def _with_dims(cells: DataFrame, dim: DataFrame) -> DataFrame:
    return cells.where("z <> 0").join(dim, KEY)


def border_clutter(cells: DataFrame, dim: DataFrame, limit: int = 5) -> DataFrame:
    """Do ``limit`` or more cells sit on one border line (corners aside) of a grid larger than 5 x 5?"""
    mid_x, mid_y = F.col("x").between(F.lit(2), F.col("nx") - 1), F.col("y").between(F.lit(2), F.col("ny") - 1)
    tallies = _with_dims(cells, dim).groupBy(KEY).agg(
        F.count_if((F.col("y") == 1) & mid_x).alias("first_row"),
        F.count_if((F.col("y") == F.col("ny")) & mid_x).alias("last_row"),
        F.count_if((F.col("x") == 1) & mid_y).alias("first_col"),
        F.count_if((F.col("x") == F.col("nx")) & mid_y).alias("last_col"),
    )
    sides = ["first_row", "last_row", "first_col", "last_col"]
    return dim.join(tallies, KEY, "left").select(
        KEY, *[F.coalesce(s, F.lit(0)).alias(s) for s in sides],
        ((F.col("nx") > 5) & (F.col("ny") > 5) & (F.coalesce(F.greatest(*sides), F.lit(0)) >= limit)).alias("cluttered"),
    )


def frame_vote(cells: DataFrame, dim: DataFrame) -> DataFrame:
    """Forward against reverse alignment in the four corners of the grid: should y be turned round?"""

    def middle(pos: str, n: str) -> Column:
        low = F.greatest(F.bround(F.col(n) * 0.25), F.lit(2.0))
        high = F.least(F.bround(F.col(n) * 0.75), F.col(n) - 2.0)
        return F.col(pos).between(F.least(low, high), F.greatest(low, high))

    framed = ((F.col("nx") >= 4) | (F.col("ny") >= 4)) & (F.col("nx") >= 2) & (F.col("ny") >= 2)
    counted = ~framed | ~(middle("x", "nx") | middle("y", "ny"))
    z = F.when(counted, F.col("z")).otherwise(0)
    votes = _with_dims(cells, dim).groupBy(KEY).agg(
        F.sum(F.greatest(z, F.lit(0))).alias("forward"), F.sum(F.greatest(-z, F.lit(0))).alias("reverse")
    )
    forward, reverse = F.coalesce("forward", F.lit(0)), F.coalesce("reverse", F.lit(0))
    none = forward + reverse == 0
    clear = none | (F.least(forward, reverse) == 0) | (F.greatest(forward, reverse) >= 2 * F.least(forward, reverse))
    return dim.select(KEY, "ny").join(votes, KEY, "left").select(
        KEY, "ny", forward.alias("forward"), reverse.alias("reverse"),
        (reverse > forward).alias("flip"), (~clear).alias("flip_unsure"),
    )


def flip_where_voted(cells: DataFrame, vote: DataFrame) -> DataFrame:
    """Reverse the rows and the signs of the grids voted for."""
    on = cells.join(vote.select(KEY, "ny", "flip"), KEY)
    return on.select(
        KEY, "x",
        F.when(F.col("flip"), F.col("ny") + 1 - F.col("y")).otherwise(F.col("y")).alias("y"),
        F.when(F.col("flip"), -F.col("z")).otherwise(F.col("z")).alias("z"),
    )


def flip_blocks(block: DataFrame, vote: DataFrame) -> DataFrame:
    """Renumber the y-blocks of flipped grids."""
    turned = F.col("flip") & (F.col("axis") == "y")
    return block.join(vote.select(KEY, "ny", "flip"), KEY).select(
        KEY, "axis", F.when(turned, F.col("ny") + 1 - F.col("idx")).otherwise(F.col("idx")).alias("idx"), "pos", "length"
    )


def estimated_score(cells: DataFrame, dim: DataFrame) -> DataFrame:
    """Share of both sequences covered by forward cells near the diagonal, in percent."""
    near = F.abs(F.col("y") - F.col("x")) < F.col("nx") * F.when(F.col("ny") < 10, 1.0).otherwise(0.25)
    kept = _with_dims(cells, dim).where(near)

    def line_maxima(line: str, n: str) -> DataFrame:
        # a line without gaps may be negative throughout; otherwise an empty cell (0) takes part
        top = F.when(F.count("*") == F.first(n), F.max("z")).otherwise(F.greatest(F.max("z"), F.lit(0)))
        return kept.groupBy(KEY, line).agg(top.alias("_top")).groupBy(KEY).agg(F.sum("_top").alias(f"cover_{line}"))

    rows, cols = line_maxima("y", "nx"), line_maxima("x", "ny")
    cover = F.coalesce("cover_y", F.lit(0)) + F.coalesce("cover_x", F.lit(0))
    return dim.join(rows, KEY, "left").join(cols, KEY, "left").select(
        KEY, (cover / (F.col("sum_x") + F.col("sum_y")) * 100).alias("estimate")
    )


def symmetry(dim: DataFrame, cutoff: float = 0.8, original: float = 1.0) -> DataFrame:
    """Shorter to longer side, and whether a grid this uneven is still worth a search."""
    s = F.least("sum_x", "sum_y") / F.greatest("sum_x", "sum_y")
    return dim.select(KEY, s.alias("symmetry"), (~((s < original * cutoff) & (F.col("ny") > 5))).alias("go_on"))


def trim_rows(cells: DataFrame) -> DataFrame:
    """Drop leading and trailing empty rows and renumber the rest."""
    kept = cells.where("z <> 0").groupBy(KEY).agg(F.min("y").alias("_lo"))
    return cells.where("z <> 0").join(kept, KEY).select(KEY, "x", (F.col("y") - F.col("_lo") + 1).alias("y"), "z")


def possible_moves(cells: DataFrame) -> DataFrame:
    """Block pairs a < b that share a row: same direction allows deletion and duplication, opposite inversion."""
    c = cells.where("z <> 0").select(KEY, "y", "x", F.signum(F.col("z").cast("double")).cast("int").alias("s"))
    other = c.select(KEY, "y", F.col("x").alias("b"), F.col("s").alias("sb"))
    pairs = c.join(other, [KEY, "y"]).where("x < b")
    return pairs.groupBy(KEY, F.col("x").alias("a"), "b").agg(
        F.bool_or(F.col("s") == F.col("sb")).alias("dupdel"), F.bool_or(F.col("s") != F.col("sb")).alias("inv")
    )


def opportunities(cells: DataFrame) -> DataFrame:
    """Moves as rows (p1, p2, sv); inversions of nothing between neighbours are left out."""
    kinds = F.array(
        F.when(F.col("dupdel"), F.lit("del")), F.when(F.col("dupdel"), F.lit("dup")),
        F.when(F.col("inv") & (F.col("b") - F.col("a") > 1), F.lit("inv")),
    )
    return possible_moves(cells).select(
        KEY, F.col("a").alias("p1"), F.col("b").alias("p2"), F.explode(F.array_compact(kinds)).alias("sv")
    )


def matrices(cells: DataFrame, block: DataFrame) -> DataFrame:
    """One row per region for the scorer: block lengths of both axes and the non-zero cells (bounded by the grid)."""
    lengths = block.groupBy(KEY).agg(
        F.sort_array(F.collect_list(F.when(F.col("axis") == "x", F.struct("idx", "length")))).alias("_x"),
        F.sort_array(F.collect_list(F.when(F.col("axis") == "y", F.struct("idx", "length")))).alias("_y"),
    )
    body = cells.where("z <> 0").groupBy(KEY).agg(
        F.collect_list(F.struct(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"),
                                F.signum(F.col("z").cast("double")).cast("int").alias("s"))).alias("_c")
    )
    empty = F.array().cast("array<int>")
    return lengths.join(body, KEY, "left").select(
        KEY, F.col("_x.length").alias("xlen"), F.col("_y.length").alias("ylen"),
        *[F.coalesce(F.col(f"_c.{c}"), empty).alias(f"c{c}") for c in ("x", "y", "s")],
    )
