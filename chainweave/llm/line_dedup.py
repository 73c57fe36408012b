"""Fuzzy line deduplication, with DataFrame functions only.

Lines are normalised (lower case; each run of anything but letters and digits is one blank). Equal normalised lines are one
line of which the first occurrence counts, by document and then by place. The distinct lines get a SimHash of 64 bits over
their distinct words. Fingerprints that differ in at most three bits agree in a whole block if the bits are cut into more
blocks than three, and in two or three whole blocks at once if into five or six; joining on those finds every such pair.
Pairs are verified by edit similarity, their connected groups are found, and each group keeps its first occurrence. Of each
line its pair with the least other is verified first (in crowded buckets stars are), then all pairs that these have not joined.

What has no letter or digit is no line to compare and stays. Documents stay too, if need be with an empty text.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainweave.llm.common import fresh
from chainweave.llm.components import components
from chainweave.session import materialise

#: Pairs whose edit distance one task takes.
PAIRS_A_TASK = 2048
#: What makes a line one to compare.
SPOKEN = r"[\p{L}\p{N}]"
DISTANCE = 3
SIMILARITY = 0.8
#: How many blocks, and how many of them make a key, up to which number of fingerprints: keys grow with the input, results do not change.
PIGEONHOLES = ((1 << 22, 4, 1), (1 << 30, 5, 2), (1 << 62, 6, 3))
#: Fingerprints in a bucket up to which its pairs are compared one by one; a fuller one is keyed by more bits.
BUCKET = 256
#: Characters of a line from which on its words, which may then be as many, are counted with wider counters.
LONG_LINE = 1 << 15
#: Distinct involved lines up to which their 16-byte keys are broadcast; beyond it they are joined by a shuffle.
FEW_LINES = 500_000


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))


def _ones(width: int, lanes: int) -> int:
    return sum(1 << (width * k) for k in range(lanes))


def _counted(hashes: Column, width: int) -> Column:
    """How often each bit is set in an array of 64-bit hashes: ``width`` longs with counters of ``width`` bits side by side.

    Good for fewer than 2^(width - 1) hashes, as the topmost counter holds the sign.
    """
    mask = F.lit(_ones(width, 64 // width))
    names = [f"c{i}" for i in range(width)]
    zero = F.struct(*(F.lit(0).cast("long").alias(c) for c in names))
    return F.aggregate(
        hashes, zero, lambda acc, h: F.struct(*((acc[c] + F.shiftrightunsigned(h, i).bitwiseAND(mask)).alias(c) for i, c in enumerate(names)))
    )


def _majority(counts: str, n: str, width: int) -> Column:
    """The bits that are set in over half of ``n`` hashes: what a counter lacks of its highest bit is added to all at once.

    The topmost counter is taken by itself, since its highest bit is the sign.
    """
    lanes, half = 64 // width, 1 << (width - 1)
    lack = F.lit(half - 1).cast("long") - F.shiftright(F.col(n).cast("long"), 1)
    others, highest = F.lit((1 << (64 - width)) - 1), F.lit(half * _ones(width, lanes - 1))
    out = None
    for i in range(width):
        c = F.col(counts)[f"c{i}"]
        low = F.shiftrightunsigned((c.bitwiseAND(others) + lack * _ones(width, lanes - 1)).bitwiseAND(highest), width - 1)
        top = F.shiftleft(F.shiftright(F.shiftrightunsigned(c, 64 - width) + lack, width - 1), 64 - width)
        bits = F.shiftleft(low.bitwiseOR(top), i)
        out = bits if out is None else out.bitwiseOR(bits)
    return out


def with_fingerprint(df: DataFrame) -> DataFrame:
    """Add ``fp`` to a table with ``norm``: a bit is set if it is set in over half of the hashes of the distinct words.

    Hashes, counts and bits are steps of their own, so that none is computed anew for each bit. Lines of up to 127, up to
    32,767 and any more words are counted with counters of 8, 16 and 32 bits.
    """
    hashed = df.withColumn("hashes", F.transform(F.array_distinct(F.split("norm", " ")), lambda w: F.xxhash64(w)))
    n, h = F.size("hashes"), F.col("hashes")
    counted = hashed.select(
        *df.columns, n.alias("n"), F.when(n < 1 << 7, _counted(h, 8)).alias("c8"),
        F.when((n >= 1 << 7) & (n < 1 << 15), _counted(h, 16)).alias("c16"), F.when(n >= 1 << 15, _counted(h, 32)).alias("c32"),
    )
    bits = F.when(F.col("n") < 1 << 7, _majority("c8", "n", 8)).when(F.col("n") < 1 << 15, _majority("c16", "n", 16)).otherwise(_majority("c32", "n", 32))
    return counted.select(*df.columns, bits.alias("fp"))


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``place, k1, k2, fp`` of every line with something to compare.

    Words are rows, counted by sums over four counters of 16 bits side by side; lines long enough to overflow them go by ``with_fingerprint``.
    """
    row, place = fresh(docs, "row"), F.struct("doc_id", "tie", "line_no").alias("place")
    norm = normalised(F.col("line")).alias("norm")
    counted = (  # rows with the same id and text are told apart, else their words would add up
        lines(docs.withColumn(row, F.monotonically_increasing_id()), id_col, text_col, row)
        .where((F.length("line") < LONG_LINE) & F.col("line").rlike(SPOKEN)).select(row, "doc_id", "tie", "line_no", norm)
        .select(row, "doc_id", "tie", "line_no", *_key(F.col("norm")), F.array_distinct(F.split("norm", " ")).alias("words"))
        .select(row, "doc_id", "tie", "line_no", "k1", "k2", F.explode("words").alias("word"))
        .select(row, "doc_id", "tie", "line_no", "k1", "k2", F.xxhash64("word").alias("h"))
        .groupBy(row, "doc_id", "tie", "line_no", "k1", "k2")
        .agg(F.count("*").alias("n"), *(F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(_ones(16, 4)))).alias(f"c{i}") for i in range(16)))
        .select("doc_id", "tie", "line_no", "k1", "k2", "n", F.struct(*(f"c{i}" for i in range(16))).alias("c"))
    )
    wide = lines(docs.where(F.length(text_col) >= LONG_LINE), id_col, text_col).where((F.length("line") >= LONG_LINE) & F.col("line").rlike(SPOKEN))
    hashed = with_fingerprint(wide.select(place, norm))
    return counted.select(place, "k1", "k2", _majority("c", "n", 16).alias("fp")).union(hashed.select("place", *_key(F.col("norm")), "fp"))


def lines(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """``doc_id, tie, line_no, line`` of every line, after columns of its document; ``tie`` tells documents with the same id apart."""
    return docs.select(*more, F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("tie"), F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))


def _key(norm: Column) -> list[Column]:
    """128 bits that stand for a normalised line."""
    return [F.xxhash64(norm).alias("k1"), F.xxhash64(norm, F.lit(1)).alias("k2")]


def _masks(blocks: int, choose: int) -> list[int]:
    """The bits of each choice of ``choose`` of the ``blocks``, as signed longs."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [sum(((1 << edges[i + 1]) - (1 << edges[i])) for i in some) for some in combinations(range(blocks), choose)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def keyed(prints: DataFrame, blocks: int, choose: int) -> DataFrame:
    """A row for each of the keys of ``id, fp``: ``combo`` (which ``choose`` of the ``blocks``), ``key`` (their bits)."""
    each = F.array(*(F.struct(F.lit(i).alias("combo"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(_masks(blocks, choose))))
    return prints.select("id", "fp", F.explode(each).alias("e")).select("id", "fp", "e.*")


def close_pairs(prints: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """``a, b`` of all ``id, fp`` whose fingerprints differ in at most ``DISTANCE`` bits, but for those that meet only in ``combo, key, id, fp, n``.

    A pair is made in the first bucket that its members share, and only there. If that one is crowded, both are keyed again by more
    bits. What is crowded even by the most is the second table.
    """
    found = None
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_b"))) <= DISTANCE
    for most, blocks, choose in PIGEONHOLES:
        if n > most:
            continue
        rows = keyed(prints, blocks, choose)
        sizes = rows.groupBy("combo", "key").agg(F.count("*").alias("n")).where("n > 1")
        met = materialise(rows.join(sizes, ["combo", "key"]))
        light = met.where(F.col("n") <= BUCKET).select("combo", "key", "id", "fp")
        other = light.select("combo", "key", F.col("id").alias("id_b"), F.col("fp").alias("fp_b"))
        unlike = F.col("fp").bitwiseXOR(F.col("fp_b"))
        first = reduce(lambda x, y: x & y, ((F.col("combo") <= i) | (unlike.bitwiseAND(F.lit(m)) != 0) for i, m in enumerate(_masks(blocks, choose))))
        pairs = light.join(other, ["combo", "key"]).where((F.col("id") < F.col("id_b")) & near & first).select(F.col("id").alias("a"), F.col("id_b").alias("b"))
        found = pairs if found is None else found.union(pairs)
        left = met.where(F.col("n") > BUCKET)
        prints = materialise(left.select("id", "fp").distinct())
        if prints.isEmpty():
            break
    return found.distinct(), left


def near_pairs(prints: DataFrame, n: int) -> DataFrame:
    """Links that connect all ``id, fp`` whose fingerprints differ in at most ``DISTANCE`` bits; a dense group by stars."""
    found, left = close_pairs(prints, n)
    return found.union(_stars(left.select("id", "fp").distinct())).distinct()


def rest_pairs(left: DataFrame, groups: DataFrame) -> DataFrame:
    """``a, b``: the pairs of crowded buckets that are near and not joined by ``groups`` yet, in blocks of about ``BUCKET`` by ``BUCKET``."""
    joined = left.join(groups.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    open_ = joined.groupBy("combo", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("combo", "key")
    blocks = F.ceil(F.col("n") / F.lit(BUCKET)).cast("int")
    cut = materialise(
        joined.join(open_, ["combo", "key"]).withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    )
    one = cut.select("combo", "key", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"), "id", "fp", "root")
    two = cut.select(
        "combo", "key", F.explode(F.sequence(F.lit(0), "own")).alias("i"), F.col("own").alias("j"),
        F.col("id").alias("id_b"), F.col("fp").alias("fp_b"), F.col("root").alias("root_b"),
    )
    once = (F.col("i") < F.col("j")) | (F.col("id") < F.col("id_b"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_b"))) <= DISTANCE
    met = one.join(two, ["combo", "key", "i", "j"]).where(once & near & (F.col("root") != F.col("root_b")))
    return met.select(F.least("id", "id_b").alias("a"), F.greatest("id", "id_b").alias("b")).distinct()


def unjoined(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``a, b`` whose ends are not in one group of ``node, root``; a node that is in none is its own."""
    for end in ("a", "b"):
        root = groups.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
        pairs = pairs.join(root, end, "left").withColumn(f"root_{end}", F.coalesce(f"root_{end}", end))
    return pairs.where("root_a <> root_b").select("a", "b")


def _stars(prints: DataFrame) -> DataFrame:
    """Whoever is within two bits of a value to which others are within one bit is linked to the least of those.

    Three bits between two fingerprints have such a value on their way, so all are connected, in rows linear in the input. A pair
    may be so through others only: what is not joined once the links are verified is for ``rest_pairs``.
    """
    flips = F.array(*(F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64)))
    one = prints.select("id", "fp", F.explode(F.concat(F.array(F.lit(0).cast("long")), flips)).alias("f")).select("id", "fp", F.col("fp").bitwiseXOR(F.col("f")).alias("z"))
    hubs = one.groupBy("z").agg(F.min("id").alias("hub"))
    two = one.select("id", F.explode(F.concat(F.array(F.lit(0).cast("long")), flips)).alias("f"), "z").select("id", F.col("z").bitwiseXOR(F.col("f")).alias("z")).distinct()
    return two.join(hubs.hint("merge"), "z").where("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()


def edit_similar(pairs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of ``a, b, norm_a, norm_b`` where 1 - edit distance / longer length is at least ``least``.

    Equal characters at both ends do not count for the distance and are taken off first. What is left is near enough if the
    longer rest is no longer than the distance allowed, or if as many words are left on both sides and exchanging those that
    differ costs no more than that; too far if the lengths differ by more; and else compared within that distance.
    """
    n_a, n_b = F.length("norm_a"), F.length("norm_b")
    allowed = F.floor((1 - least) * F.greatest(n_a, n_b) + 1e-9).cast("int")
    steps = F.array(*(F.lit(1 << k) for k in range(14, -1, -1)))

    def cut(x: Column, y: Column) -> Column:
        """Both without what they start with alike; of very much that is equal some may stay, which costs time only."""
        return F.aggregate(
            steps, F.struct(x.alias("x"), y.alias("y")),
            lambda s, n: F.when(
                s["x"].substr(F.lit(1), n) == s["y"].substr(F.lit(1), n),
                F.struct(s["x"].substr(n + 1, F.length(s["x"])).alias("x"), s["y"].substr(n + 1, F.length(s["y"])).alias("y")),
            ).otherwise(s),
        )

    near = pairs.withColumn("allowed", allowed).where(F.abs(n_a - n_b) <= F.col("allowed"))
    # as a generated row it is made once; a filter would compute a plain column anew wherever it names it
    both = F.transform(F.array(cut(F.col("norm_a"), F.col("norm_b"))), lambda s: cut(F.reverse(s["x"]), F.reverse(s["y"])))
    left = near.select("a", "b", "allowed", F.explode(both).alias("s")).select("a", "b", "allowed", "s.x", "s.y")
    u, v = F.split("x", " "), F.split("y", " ")
    # a word becomes another by at most as many edits as the longer has letters
    price = F.aggregate(F.zip_with(u, v, lambda p, q: F.when(p == q, 0).otherwise(F.greatest(F.length(p), F.length(q)))), F.lit(0), lambda n, k: n + k)
    short = F.greatest(F.length("x"), F.length("y")) <= F.col("allowed")
    exchanged = F.when(F.size(u) == F.size(v), price <= F.col("allowed")).otherwise(False)
    return left.where(F.when(short, True).when(exchanged, True).otherwise(F.expr("levenshtein(x, y, allowed) >= 0"))).select("a", "b")


def first_occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, tie, line_no`` of every line that stays."""
    every = lines(docs, id_col, text_col)
    spoken = F.col("line").rlike(SPOKEN)
    norm = normalised(F.col("line")).alias("norm")
    distinct = materialise(
        fingerprints(docs, id_col, text_col).groupBy("k1", "k2").agg(F.min("place").alias("place"), F.first("fp").alias("fp"))
        .withColumn("id", F.xxhash64("k1", "k2"))
    )

    def similar(pairs: DataFrame) -> DataFrame:
        """The pairs that are similar."""
        involved = materialise(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct())
        few = involved.count() <= FEW_LINES
        wanted = distinct.join(F.broadcast(involved) if few else involved, "id").select("id", "place.*")
        texts = materialise(
            every.join(F.broadcast(wanted) if few else wanted, (every.doc_id.eqNullSafe(wanted.doc_id)) & (every.tie == wanted.tie) & (every.line_no == wanted.line_no))
            .select("id", norm).distinct()
        )
        a, b = texts.select(F.col("id").alias("a"), F.col("norm").alias("norm_a")), texts.select(F.col("id").alias("b"), F.col("norm").alias("norm_b"))
        # few bytes may be much work: the last join has tasks by number of pairs, and the distance is taken behind it
        spread = pairs.join(a, "a").repartition(max(1, pairs.count() // PAIRS_A_TASK), "b").join(b, "b")
        return materialise(edit_similar(spread, similarity))

    found, left = close_pairs(distinct.select("id", "fp"), distinct.count())
    found, crowded = materialise(found), not left.isEmpty()
    begun = found.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    edges = similar(materialise(begun.union(_stars(left.select("id", "fp").distinct())).distinct() if crowded else begun))
    groups = components(edges)
    # what these have joined needs no more pairs; of the rest all pairs are compared
    rest = unjoined(found, groups)
    rest = materialise(rest.union(rest_pairs(left, groups)).distinct() if crowded else rest)
    if not rest.isEmpty():
        groups = components(edges.union(similar(rest)))
    later = (
        groups.join(distinct.select(F.col("id").alias("node"), "place"), "node")
        .groupBy("root").agg(F.min("place").alias("first")).select(F.col("first").alias("place"))
    )
    alone = distinct.join(groups.select(F.col("node").alias("id")), "id", "left_anti").select("place")
    blank = every.where(~spoken).select("doc_id", "tie", "line_no")
    return alone.union(later).select("place.*").union(blank)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The documents with the lines that stay, and ``n_lines, n_removed``; all other columns as they were.

    A null text stays null and has no lines, an empty one has one blank line. Rows with the same id and text are one
    document here: their lines stay or go alike. Rows with the same id and other texts go by a hash of the text. An empty
    table gives no rows. Columns of the input called n_lines or n_removed are kept, and the new ones get a longer name.
    """
    n_lines, n_removed, own_id, own_tie, stays, tie = (fresh(docs, c) for c in ("n_lines", "n_removed", "own_id", "own_tie", "stays", "tie"))
    kept = (
        first_occurrences(docs, id_col, text_col, similarity).groupBy("doc_id", "tie")
        .agg(F.array_sort(F.collect_set("line_no")).alias("stay"))
        .toDF(own_id, own_tie, stays)
    )
    out = docs.withColumn(tie, F.xxhash64(text_col)).join(kept, F.col(id_col).eqNullSafe(F.col(own_id)) & (F.col(tie) == F.col(own_tie)), "left")
    # the split lines are a column of their own, else the text would be split anew for every line
    parts = fresh(out, "parts")
    out = out.withColumn(parts, F.split(text_col, "\n"))
    stay = F.coalesce(stays, F.array().cast("array<int>"))
    text = F.when(F.col(text_col).isNotNull(), F.array_join(F.transform(stay, lambda i: F.get(F.col(parts), i)), "\n"))
    count = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(parts))
    return out.select(
        *(F.col(c) if c != text_col else text.alias(c) for c in docs.columns),
        count.cast("long").alias(n_lines), (count - F.size(stay)).cast("long").alias(n_removed),
    )
