"""Mixing sources to target weights, with DataFrame functions only.

The words of a source are packed, document after document, into blocks of a fixed length. Every slot of the mix holds one
block. The output shards draw how many slots each source gets: multinomial draws, conditioned on the sources' totals over
all shards, which are the rounded targets; such draws are the counts that a pseudorandom permutation of all slots gives. A source's draws are
numbered by prefix sums of its counts over the shards, go through its blocks by a pseudorandom permutation of their indices, a new
one for each pass, and blocks are joined by index to the shards. What the mix takes of a document is counted in the shards. Permutations are computed index by index (swap-or-not rounds), so nothing is sorted, kept or sent for them.

Where a source's documents begin in it is a prefix sum in two levels: over tiles of about the root of the number of
documents, and over the documents of a tile. So no task reads a whole source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainweave.llm.common import WORD, fresh
from chainweave.session import materialise

WEIGHTS = (5, 2, 1)
#: A document is taken at most so many times.
MOST_PASSES = 3
BLOCK_WORDS = 32
SHARD_SLOTS = 8192
DRAWS_A_TASK = 32_768
ROUNDS = 12
#: Shards of a tile of a prefix sum.
TILE_SHARDS = 4096
SEED = 20_111
#: Sources up to which their table is broadcast (a few dozen bytes a row); beyond it the join is salted.
FEW_SOURCES = 50_000
SALTS = 32


@dataclass
class Mix:
    """documents: doc_id, source_no, size, start; sources: with targets; slots: shard, position, source_no, block."""

    documents: DataFrame
    sources: DataFrame
    slots: DataFrame


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, source, size``: the number of words of the whole text (null: 0)."""
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )


def with_targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """Add source_no, weight and target to ``source, source_size`` (a row a source).

    Sources by code point, null last, weigh as ``weights`` says, repeating, and share the sum of all sizes. With the shares
    a weight can get before its cap in ascending order, a source is capped if what is left for one unit of weight, after all
    that are capped before it, is more than that; the others get what is left for a unit of weight times their weight.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    before = Window.orderBy("reach", "source_no").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    cap = most * F.col("source_size")
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    unit = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    return (
        by_source.withColumn("source_no", F.row_number().over(named))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("source_no") - 1, F.lit(len(weights))) + 1))
        .withColumn("reach", cap / F.col("weight"))
        .withColumn("unit", unit)
        .withColumn("capped", F.col("unit") > F.col("reach"))
        .withColumn("level", F.max(F.when(~F.col("capped"), F.col("unit"))).over(everything))
        .withColumn("target", F.when(F.col("capped"), cap.cast("double")).otherwise(F.least(F.col("level") * F.col("weight"), cap.cast("double"))))
        .select("source", "source_no", "source_size", "weight", "target")
    )


def permuted(index: Column, n: Column, *key: Column) -> Column:
    """A pseudorandom permutation of 0 to n - 1 at ``index``: each round pairs x with k - x (mod n) and swaps by a hash of the pair."""

    def swapped(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*key, r), n) - x, n)
        coin = F.xxhash64(F.greatest(x, other), r, *key).bitwiseAND(F.lit(1))
        return F.when(coin == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), index.cast("long"), swapped)


def with_source(rows: DataFrame, sources: DataFrame, on: str, *columns: str, salt_by: str = "doc_id") -> DataFrame:
    """Join the sources' table by ``on`` (null equals null), without sending a hot source to one task."""
    small = sources.select(F.col(on).alias("own_"), *(F.col(c) for c in columns))
    if sources.count() <= FEW_SOURCES:
        return rows.join(F.broadcast(small), F.col(on).eqNullSafe(F.col("own_"))).drop("own_")
    salted = small.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("dealt_", F.pmod(F.xxhash64(salt_by), F.lit(SALTS)))
    return dealt.join(salted, F.col(on).eqNullSafe(F.col("own_")) & (F.col("dealt_") == F.col("salt_"))).drop("own_", "salt_", "dealt_")


def placed(counted: DataFrame) -> DataFrame:
    """Add ``start``, the words of a document's source before it, to ``doc_id, source_no, size``."""
    tiles = max(1, round(counted.count() ** 0.5))
    tiled = counted.withColumn("tile", F.pmod(F.xxhash64("doc_id", "size"), F.lit(tiles)))
    inside = Window.partitionBy("source_no", "tile").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("source_no").orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        tiled.groupBy("source_no", "tile").agg(F.sum("size").alias("words"))
        .select("source_no", "tile", F.coalesce(F.sum("words").over(upto), F.lit(0)).alias("base"))
    )
    within = tiled.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return within.join(base, ["source_no", "tile"]).select("doc_id", "source_no", "size", (F.col("base") + F.col("within")).alias("start"))


def summed_before(rows: DataFrame, keys: tuple[str, ...], order: str, value: str, name: str, tile: int = TILE_SHARDS) -> DataFrame:
    """Add ``name``, the sum of ``value`` over the rows of the same keys with a lesser ``order``: within tiles, and over the tiles' sums."""
    tiled = rows.withColumn("tile_", F.floor(F.col(order) / tile))
    inside = Window.partitionBy(*keys, "tile_").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy("tile_").rowsBetween(Window.unboundedPreceding, -1)
    base = tiled.groupBy(*keys, "tile_").agg(F.sum(value).alias("sum_")).select(*keys, "tile_", F.coalesce(F.sum("sum_").over(upto), F.lit(0)).alias("base_"))
    within = tiled.withColumn("within_", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return within.join(base, [*keys, "tile_"]).withColumn(name, F.col("base_") + F.col("within_")).drop("tile_", "base_", "within_")


def shard_counts(quota: DataFrame, shard_slots: int, tasks: int, seed: int) -> DataFrame:
    """``shard, source_no, drawn``: how many slots of each shard a source gets.

    The draws are multinomial, conditioned on the sources' totals: a pseudorandom permutation deals all slots out, and the shard that a slot falls
    into counts it.
    """
    # few rows that grow into many: they are spread before they grow, in two steps, so that no row holds a long array
    coarse = quota.withColumn("from", F.explode(F.expr("sequence(0L, draws - 1, 16777216L)")))
    fine = coarse.withColumn("from", F.explode(F.expr("sequence(from, least(from + 16777216L, draws) - 1, 4096L)")))
    dealt = fine.repartition(tasks, "source_no", "from")
    each = dealt.withColumn("draw", F.explode(F.expr("sequence(from, least(from + 4096L, draws) - 1)")))
    slot = permuted(F.col("first") + F.col("draw"), F.col("slots"), F.lit(seed))
    return each.select(F.floor(slot / shard_slots).cast("long").alias("shard"), "source_no").groupBy("shard", "source_no").agg(F.count("*").alias("drawn"))


def draw(sources: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """``shard, position, source_no, block``: a row for every slot of the mix.

    A shard's slots of a source are that source's next draws, numbered on from the shards before it; the draw's number says which pass
    over the source it belongs to and, through the pass's permutation, which block it takes.
    """
    upto = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    filled = sources.where("source_size > 0").withColumn("blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
    quota = materialise(
        filled.withColumn("draws", F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"))
        .where("draws > 0")
        .withColumn("first", F.coalesce(F.sum("draws").over(upto), F.lit(0)))
        .withColumn("slots", F.sum("draws").over(Window.partitionBy()))
        .select("source_no", "blocks", "draws", "first", "slots")
    )
    slots = quota.agg(F.max("slots")).first()[0] or 0
    tasks = max(1, slots // DRAWS_A_TASK)
    drawn = materialise(shard_counts(quota, shard_slots, tasks, seed))
    numbered = summed_before(drawn, ("source_no",), "shard", "drawn", "number")
    # where a source's slots begin among those of a shard; a shard has at most so many sources as slots
    beside = Window.partitionBy("shard").orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("shard")
    placed_ = numbered.withColumns({"ahead": F.coalesce(F.sum("drawn").over(beside), F.lit(0)), "room": F.sum("drawn").over(whole)})
    counts = with_source(placed_, quota, "source_no", "blocks", salt_by="shard")
    each = counts.repartition(tasks, "shard", "source_no").withColumn("k", F.explode(F.expr("sequence(0L, drawn - 1)")))
    number = F.col("number") + F.col("k")
    passes, index = F.floor(number / F.col("blocks")).cast("long"), F.pmod(number, F.col("blocks"))
    return each.select(
        "shard", permuted(F.col("ahead") + F.col("k"), F.col("room"), F.lit(seed), F.col("shard")).alias("position"), "source_no",
        permuted(index, F.col("blocks"), F.lit(seed), F.col("source_no"), passes).alias("block"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS,
        most: int = MOST_PASSES, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> Mix:
    """Mix whole documents to the targets of their sources.

    A null text has no words and is never taken; an empty or very long text is one like others; a null source is a source of its own; a null id is kept; repeated rows are
    packed one after the other and taken each; an empty table gives an empty mix; columns beyond the three named are not
    read. A source's words in the mix differ from its target by about a block at most, and no block is drawn more than
    ``most`` times.
    """
    counted = materialise(sizes(docs, id_col, text_col, source_col))
    sources = materialise(with_targets(counted.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    numbered = with_source(counted, sources, "source", "source_no").select("doc_id", "source_no", "size")
    return Mix(placed(numbered), sources, draw(sources, block_words, shard_slots, seed))


def overlaps(documents: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row for each block that a document has words in, with how many (``words``)."""
    block = F.explode(F.expr(f"sequence(start div {block_words}, (start + size - 1) div {block_words})")).alias("block")
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    return documents.where("size > 0").select("*", block).withColumn("words", end - F.greatest("start", F.col("block") * block_words))


def shards(m: Mix, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix itself: ``shard, position, source_no, block, doc_id, size, start, from_word, words``, a row for each document's part in a slot's block.

    ``from_word`` is the part's first word in its document. Slots in order of position, and within them parts in order of ``start``, are a
    shard's text.
    """
    parts = overlaps(m.documents, block_words)
    # the hint keeps the planner from taking the slots, made from a tiny table, for small
    found = m.slots.hint("merge").join(parts, ["source_no", "block"])
    from_word = F.greatest(F.col("block") * block_words - F.col("start"), F.lit(0))
    return found.select("shard", "position", "source_no", "block", "doc_id", "size", "start", from_word.alias("from_word"), "words")


def taken(m: Mix, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, source_no, size, taken``: how many words of each document the shards hold, repeats counted."""
    sums = shards(m, block_words).groupBy("source_no", "start").agg(F.sum("words").alias("taken"))
    here = m.documents.withColumnRenamed("start", "at_").alias("d").join(
        sums.alias("s"),
        # documents with words begin at places of their own
        (F.col("d.source_no") == F.col("s.source_no")) & (F.col("at_") == F.col("s.start")) & (F.col("d.size") > 0), "left",
    )
    return here.select("d.doc_id", "d.source_no", "d.size", F.coalesce("s.taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    weights: tuple[int, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """Whole documents as often as the mix takes their words: that number is rounded up or down at random, by a hash, so
    that a source's words come near its target. Documents that are not taken are not returned; those taken twice or three
    times are returned so often, with all their columns. Documents without a word are never taken. Null ids and sources are kept, repeated rows
    share what the mix takes of them, an empty table gives no rows, and a column's name may be one that is used inside.
    """
    key, times, turn = (fresh(docs, c) for c in ("key", "times", "turn"))
    keyed = docs.withColumn(key, F.xxhash64(id_col, text_col, source_col))
    m = mix(keyed, key, text_col, source_col, weights, seed=seed)
    share = taken(m).where("size > 0").groupBy("doc_id").agg((F.sum("taken") / F.sum("size")).alias("share"))
    luck = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) / (1 << 20)
    often = share.select(F.col("doc_id").alias(key), F.floor(F.col("share") + luck).cast("int").alias(times)).where(F.col(times) > 0)
    return keyed.join(often, key).select(*docs.columns, F.explode(F.sequence(F.lit(1), times)).alias(turn)).select(*docs.columns)
