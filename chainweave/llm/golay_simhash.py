"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into three segments of at most 23 bits. The perfect (23, 12) code has, for any segment,
one codeword within distance 3, and six codewords within distance 4 where that one is at distance 3. Two segments that
differ in at most two bits share at least one codeword near to both. Two fingerprints that differ in at most two bits
agree in at least one segment, and the segment behind it differs in at most two bits. So the key (which segment, its
bits, a codeword index near the next segment) is shared by every linked pair: a fingerprint has 3 to 18 keys, linked
fingerprints meet in a bucket, and the pairs of a bucket are verified.

``near_duplicates`` links fingerprints of shingles. ``deduplicate`` keeps one document of each group of similar ones by the
Jaccard similarity of their five-word shingles. Fingerprints over the distinct words join most of them cheaply. The rest is
found by an exact prefix filter: shingles are put in one order for all texts, and texts with a similarity of s or more share
a shingle among the first n - ceil(s n) + 1 of each. Every pair that meets there and is not joined yet is verified.

Only distinct fingerprints enter, each with its least document. A bucket with more than ``BUCKET`` fingerprints is not
paired: its fingerprints spread to the 65 values within one bit, and all that meet at a value (they differ in at most
two bits through it) are linked to the least of them. That is exact too and linear in the bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainweave.llm.common import fresh
from chainweave.llm.components import components
from chainweave.llm.suffix_dedup import _bitmap
from chainweave.session import materialise

#: Places and widths of the segments of a fingerprint.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the (23, 12) code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 (fixed value).
GENERATOR = 0b101011100011
DISTANCE = 2
#: Fingerprints in a bucket up to which its pairs are verified one by one.
BUCKET = 32
LANES = np.uint64(0x0101010101010101)
SEED = 42


def _syndromes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits of a segment, and for each syndrome the error patterns of up to 4 bits."""
    unit = []
    for i in range(23):
        v = 1 << i
        for k in range(i, 10, -1):
            if v >> k & 1:
                v ^= GENERATOR << (k - 11)
        unit.append(v)
    near: dict[int, list[int]] = {}
    for weight in range(5):
        for places in combinations(range(23), weight):
            syndrome = error = 0
            for i in places:
                syndrome ^= unit[i]
                error |= 1 << i
            if weight < 4 or near[syndrome][0].bit_count() == 3:
                near.setdefault(syndrome, []).append(error)
    low, high = np.zeros(4096, np.int64), np.zeros(2048, np.int64)
    for i in range(23):
        part, k = (low, i) if i < 12 else (high, i - 12)
        part[(np.arange(len(part)) >> k) & 1 == 1] ^= unit[i]
    errors = np.full((2048, 6), -1, np.int64)
    for syndrome, found in near.items():
        errors[syndrome, : len(found)] = found
    return low, high, errors


def codeword_indices(segment: np.ndarray) -> np.ndarray:
    """The indices (12 bits) of the codewords near each segment, six columns, -1 where there are fewer."""
    low, high, errors = _TABLES
    found = errors[low[segment & 4095] ^ high[segment >> 12]]
    return np.where(found < 0, -1, (segment[:, None] ^ found) >> 11)


_TABLES = _syndromes()


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For int64 fingerprints: which fingerprint (its place), and the key."""
    bits = prints.view(np.uint64)
    parts = [((bits >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    of, out = [], []
    for k in range(3):
        near = codeword_indices(parts[(k + 1) % 3])
        key = np.where(near < 0, -1, (k << 40) | (parts[k][:, None] << 12) | near)
        i, j = np.nonzero(near >= 0)
        of.append(i)
        out.append(key[i, j])
    return np.concatenate(of), np.concatenate(out)


def bit_counts(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set in each of the consecutive runs of hashes (runs of at least one).

    Eight byte-wide counters share a word; runs are cut at 255 so that none overflows.
    """
    blocks = -(-sizes // 255)
    first = np.cumsum(sizes) - sizes
    within = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    starts = np.repeat(first, blocks) + 255 * within
    counts = np.empty((len(starts), 8, 8), np.int64)
    for j in range(8):
        lane = np.add.reduceat((hashes >> np.uint64(j)) & LANES, starts)
        counts[:, :, j] = lane.view(np.uint8).reshape(-1, 8)
    return np.add.reduceat(counts.reshape(-1, 64), np.cumsum(blocks) - blocks, axis=0)


def text_hashes(text: bytes, width: int) -> list[int]:
    """XXH64 (seed 42) of every shingle of ``width`` words of the text, A-Z lower-cased; of all words if there are fewer."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return []
    plain = b" ".join(words)
    ends = np.append(np.flatnonzero(np.frombuffer(plain, np.uint8) == 32), len(plain))
    starts = np.append(0, ends[:-1] + 1)
    k = max(0, len(words) - width)
    return [xxh64_intdigest(plain[a:b], SEED) for a, b in zip(starts[: k + 1].tolist(), ends[len(words) - k - 1 :].tolist())]


def fingerprints(texts: list[bytes | None], width: int) -> np.ndarray:
    """Signed 64-bit fingerprints: a bit is set if it is set in over half of the shingle hashes; zero without words."""
    out = np.zeros(len(texts), np.uint64)
    rows = [(i, h) for i, t in enumerate(texts) if t and (h := text_hashes(t, width))]
    if rows:
        sizes = np.array([len(h) for _, h in rows])
        counts = bit_counts(np.array([x for _, h in rows for x in h], np.uint64), sizes)
        set_bits = np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little")
        out[[i for i, _ in rows]] = np.ascontiguousarray(set_bits).view(np.uint64).ravel()
    return out.view(np.int64)


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``doc_id, fp`` of every document, from its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                fp = fingerprints([x.as_buffer().to_pybytes() if x.is_valid else None for x in some.column(1)], width)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary")).mapInArrow(run, "doc_id long, fp long")


def with_keys(prints: DataFrame) -> DataFrame:
    """``fp, key``: a row for each Golay key of each distinct fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                fp = batch.column(0).to_numpy()
                of, key = keys(fp)
                yield pa.RecordBatch.from_arrays([pa.array(fp[of]), pa.array(key)], ["fp", "key"])

    return prints.select("fp").mapInArrow(run, "fp long, key long")


def links(prints: DataFrame) -> DataFrame:
    """``a, b``: links enough to connect all distinct fingerprints that differ in at most ``DISTANCE`` bits."""
    keyed = materialise(with_keys(prints))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = materialise(keyed.join(sizes, "key"))
    light = met.where(F.col("n") <= BUCKET)
    other = light.select("key", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    pairs = light.select("key", F.col("fp").alias("a")).join(other, "key").where((F.col("a") < F.col("b")) & near)
    crowded = met.where(F.col("n") > BUCKET).select("fp").distinct()
    return pairs.select("a", "b").union(_ball_links(crowded))


def _ball_links(prints: DataFrame) -> DataFrame:
    """Link all fingerprints that share a value within one bit of each (so two bits lie between them) to the least of them."""
    flipped = F.when(F.col("i") < 0, F.col("fp")).otherwise(F.expr("fp ^ shiftleft(1L, i)"))
    at = prints.select("fp", F.explode(F.sequence(F.lit(-1), F.lit(63))).alias("i")).select("fp", flipped.alias("z"))
    hubs = at.groupBy("z").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1").select("z", "hub")
    return at.join(hubs.hint("merge"), "z").where("fp <> hub").select(F.col("hub").alias("a"), F.col("fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every document.

    component_id is the least doc_id that links of at most two differing bits reach. A null or wordless text has
    fingerprint zero and links like any other; a null doc_id is returned but never the least unless a component has no
    other; repeated rows are all returned; an empty table gives no rows; columns beyond the two named are not read.
    """
    prints = materialise(with_fingerprint(docs, id_col, text_col, width))
    labelled = with_components(prints)
    return labelled.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def with_components(prints: DataFrame) -> DataFrame:
    """Add component_id to ``doc_id, fp``."""
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(distinct)).withColumnRenamed("node", "fp")
    least = roots.join(distinct, "fp").groupBy("root").agg(F.min("first").alias("component_id"))
    moved = roots.join(least, "root").select("fp", "component_id")
    of = distinct.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return prints.join(of, "fp")


#: Fingerprints over the distinct words by which candidates are found, and what verified similarity means.
WORD_PRINTS = 4
SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: Texts up to which their 16-byte keys are broadcast; beyond it they are joined by a shuffle.
FEW_TEXTS = 500_000
#: Shingles whose highest byte is below this are counted over all texts: more than a prefix needs of most texts.
COUNTED = np.uint64(77)
#: Rounds in which the texts of a crowded token are compared with one of them, before all pairs that are left are.
HUB_ROUNDS = 2


def word_fingerprints(texts: list[bytes | None], prints: int = WORD_PRINTS) -> np.ndarray:
    """A column for each of several fingerprints over the distinct words of each text; zeros without words."""
    from xxhash import xxh64_intdigest

    out = np.zeros((len(texts), prints), np.int64)
    rows = [(i, w) for i, t in enumerate(texts) if t and (w := set(t.lower().split()))]
    if rows:
        sizes = np.array([len(w) for _, w in rows])
        hashes = np.array([xxh64_intdigest(x, SEED) for _, w in rows for x in w], np.uint64)
        for k in range(prints):
            x = (hashes ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            bits = np.packbits(2 * bit_counts(x ^ (x >> np.uint64(29)), sizes) > sizes[:, None], axis=1, bitorder="little")
            out[[i for i, _ in rows], k] = np.ascontiguousarray(bits).view(np.int64).ravel()
    return out


def shingle_set(text: bytes, width: int = SHINGLE_WORDS) -> np.ndarray:
    return np.unique(np.array(text_hashes(text, width), np.uint64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sets of hashes; two empty ones are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def _candidates(texts: DataFrame) -> DataFrame:
    """``a, b`` (nodes) of ``node, fps``: of each fingerprint, texts that share it with its least text, and least texts of linked ones."""
    found = None
    for k in range(WORD_PRINTS):
        of = materialise(texts.select("node", F.col("fps")[k].alias("fp")))
        least = materialise(of.groupBy("fp").agg(F.min("node").alias("least")))
        shared = of.join(least, "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
        at, to = least.toDF("a_fp", "a"), least.toDF("b_fp", "b")
        linked = links(least).toDF("a_fp", "b_fp").join(at, "a_fp").join(to, "b_fp").select("a", "b")
        found = shared.union(linked) if found is None else found.union(shared).union(linked)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _has(marks: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    word = (hashes >> np.uint64(6) & np.uint64(len(marks) - 1)).astype(np.int64)
    return (marks[word] >> (hashes & np.uint64(63)) & np.uint64(1)).astype(bool)


def prefix(hashes: np.ndarray, similarity: float, twice: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The shingles of a text under which it meets all texts with ``similarity`` or more; 0 for a text without shingles.

    Order: counted shingles that no other text has, counted ones of few texts, those not counted, those of many texts; each
    by hash. It follows from the hash and the bitmaps alone, so it is the same for all texts, and a bit set in vain costs
    only time. The first kind meets nothing and is not returned.
    """
    n = len(hashes)
    if not n:
        return np.zeros(1, np.uint64)
    counted = hashes >> np.uint64(56) < COUNTED
    kind = np.where(counted, np.where(_has(often, hashes), 3, np.where(_has(twice, hashes), 1, 0)), 2)
    first = np.lexsort((hashes, kind))[: n - math.ceil(similarity * n - 1e-9) + 1]
    return hashes[first[kind[first] > 0]]


def _prefixes(raw: DataFrame, similarity: float) -> DataFrame:
    """``token, node, size`` (number of shingles) of ``node, raw``, for every shingle in a text's prefix."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                sets = [shingle_set(x) for x in _raw(batch.slice(at, 500).column(1))]
                h, n = np.unique(np.concatenate([x[x >> np.uint64(56) < COUNTED] for x in sets]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int32))], ["h", "n"])

    met = materialise(raw.mapInArrow(count, "h long, n int").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1"))
    marks = raw.sparkSession.sparkContext.broadcast((_bitmap(met), _bitmap(met.where(F.col("n") > BUCKET))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                sets = [shingle_set(x) for x in _raw(some.column(1))]
                tokens = [prefix(x, similarity, *marks.value) for x in sets]
                of = np.repeat(np.arange(len(sets)), [len(x) for x in tokens])
                sizes = np.array([len(x) for x in sets], np.int32)[of]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), some.column(0).take(pa.array(of)), pa.array(sizes)], ["token", "node", "size"])

    return raw.mapInArrow(run, "token long, node long, size int").distinct()


def _raw(column: pa.Array) -> list[bytes]:
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in column]


def _unsettled(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``token, n, node, size, comp`` of the tokens whose texts are not all joined; of tokens with the same texts one."""
    joined = rows.join(groups, "node", "left").select("token", "node", "size", F.coalesce("root", "node").alias("comp"))
    told = joined.groupBy("token").agg(
        F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.bit_xor("node").alias("x"), F.bit_xor(F.xxhash64("node")).alias("y")
    )
    one = told.where("lo <> hi").groupBy("n", "x", "y").agg(F.min("token").alias("token")).select("token", "n")
    return materialise(joined.join(one, "token").select("token", "n", "node", "size", "comp"))


def _alike(similarity: float) -> Column:
    """Whether two texts are not joined yet and near enough in size."""
    a, b = F.col("size").cast("double"), F.col("size_b").cast("double")
    return (F.col("comp") != F.col("comp_b")) & (F.least(a, b) >= similarity * F.greatest(a, b) - 1e-6)


def _hub_pairs(rows: DataFrame, similarity: float, turn: int) -> DataFrame:
    """``a, b``: each text of a crowded token and one that chance chooses among them."""
    hub = rows.groupBy("token").agg(F.min_by(F.struct("node", "size", "comp"), F.xxhash64("node", F.lit(turn))).alias("hub"))
    met = rows.join(hub.select("token", F.col("hub.node").alias("b"), F.col("hub.size").alias("size_b"), F.col("hub.comp").alias("comp_b")), "token")
    return met.where(_alike(similarity)).select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()


def _all_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: all pairs of a token's texts that are not joined; crowded tokens in blocks of about ``BUCKET`` by ``BUCKET``."""
    blocks = F.ceil(F.col("n") / F.lit(max(1, BUCKET))).cast("int")
    cut = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    left = cut.select("token", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"), "node", "size", "comp")
    right = cut.select(
        "token", F.explode(F.sequence(F.lit(0), "own")).alias("i"), F.col("own").alias("j"), F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("comp").alias("comp_b")
    )
    met = left.join(right, ["token", "i", "j"]).where(((F.col("i") < F.col("j")) | (F.col("node") < F.col("b"))) & _alike(similarity))
    return met.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The documents, with all columns, but of each group of similar ones only that with the least id (null first).

    Equal texts are similar; so are all texts whose five-word shingles have a Jaccard similarity of ``similarity`` or more
    (A-Z in lower case; a text of fewer words is one shingle). Groups are connected. A null text is
    one without a word, and those are all alike. Of equal rows one stays. An empty table gives no rows.
    Columns of any other name pass through.
    """
    did, k1, k2, turn = (fresh(docs, c) for c in ("did", "k1", "k2", "turn"))
    keys = {did: F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))), k1: F.xxhash64(text_col), k2: F.xxhash64(text_col, F.lit(1))}
    marked = docs.withColumns(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                fps = word_fingerprints([x.as_buffer().to_pybytes() if x.is_valid else None for x in some.column(3)])
                yield pa.RecordBatch.from_arrays([*some.columns[:3], pa.array(list(fps), pa.list_(pa.int64()))], ["did", "k1", "k2", "fps"])

    printed = marked.select(did, k1, k2, F.col(text_col).cast("binary")).mapInArrow(run, "did long, k1 long, k2 long, fps array<long>")
    texts = materialise(
        printed.groupBy("k1", "k2").agg(F.min("did").alias("did"), F.first("fps").alias("fps")).withColumn("node", F.xxhash64("k1", "k2"))
    )

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x).tobytes() for x in _raw(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "shingles"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(i)] for i in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array([jaccard(p, q) >= similarity for p, q in zip(x, y)], pa.bool_()))

    def similar(pairs: DataFrame) -> DataFrame:
        """The pairs that are similar."""
        involved = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        wanted = materialise(texts.join(involved, "node").select("node", "did", "k1", "k2"))
        named = wanted.toDF("node", did, k1, k2)
        small = F.broadcast(named) if wanted.count() <= FEW_TEXTS else named
        raw = marked.select(did, k1, k2, F.col(text_col).cast("binary").alias("raw_")).join(small, [did, k1, k2]).select("node", "raw_")
        sets = materialise(raw.mapInArrow(shingled, "node long, shingles binary").dropDuplicates(["node"]))
        joined = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b").select("a", "b", "set_a", "set_b")
        return materialise(joined.mapInArrow(compared, "a long, b long"))

    edges = similar(materialise(_candidates(texts)))
    groups = components(edges)
    rows = materialise(_prefixes(marked.select(F.xxhash64(k1, k2).alias("node"), F.col(text_col).cast("binary").alias("raw")), similarity))
    met = _unsettled(rows, groups)
    for k in range(HUB_ROUNDS):
        crowded = met.where(F.col("n") > BUCKET)
        if crowded.isEmpty():
            break
        edges = edges.union(similar(materialise(_hub_pairs(crowded, similarity, k))))
        groups = components(edges)
        met = _unsettled(met.select("token", "node", "size"), groups)
    edges = edges.union(similar(materialise(_all_pairs(met, similarity))))
    groups = components(edges)
    of = texts.join(groups, "node", "left").select(F.coalesce("root", "node").alias("group"), F.struct("did", "k1", "k2").alias("place"))
    stay = materialise(of.groupBy("group").agg(F.min("place").alias("place")).select("place.*"))
    once = Window.partitionBy(did, k1, k2).orderBy(F.lit(1))
    kept = marked.join(stay.toDF(did, k1, k2), [did, k1, k2])
    return kept.withColumn(turn, F.row_number().over(once)).where(F.col(turn) == 1).select(*docs.columns)
