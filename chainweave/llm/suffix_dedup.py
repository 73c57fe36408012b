"""Removal of repeated byte strings, decided by suffix arrays built by linear grouping.

A string of ``LENGTH`` bytes repeats if it starts earlier too: in an earlier document, or earlier in its own. Which
strings can repeat is found first. Every window of ``LENGTH`` bytes is owned by an anchor, the least of its ``GRAM``-byte
grams by hash, so equal windows have equal anchors at equal places. Only anchors seen twice matter. Occurrences of an
anchor whose owned bytes are all equal are a class: in all but its earliest occurrence every owned window repeats.

Where an anchor has several classes, the owned bytes of their earliest occurrences are compared by a suffix array: windows
that start equal suffixes stand together in it. The array is built by grouping: suffixes are kept in groups by the longest
Lyndon prefix known of them; groups are processed from the highest to the lowest; each member points to the previous
suffix in a lower group, and what is pointed at moves into a new group just above its own, the more often the higher. When
all are done, one pass over the array writes each suffix to the front of its group and follows its pointers. Nothing is
renamed or sorted recursively.

Anchors with more than ``CROWD`` classes are not gathered in a task: there, windows are compared by 128-bit hashes in an
aggregation. That is linear too and finds the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainweave.session import materialise

LENGTH = 100
GRAM = 48
#: Bases of the rolling hashes of grams and of owned bytes (odd, so that they can be divided out).
GRAM_BASE, CLASS_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
CHUNK_BYTES = 1_500_000
#: Bits for a place among the texts that are looked through at once.
PLACE_BITS = 24
CROWD = 2000
#: Bytes after which a suffix array is full (whole anchors): twice as fast a byte as with 100,000, since its lists stay in the cache.
ARRAY_BYTES = 10_000
#: Rows up to which a table of owned places (some 40 bytes each) is broadcast; beyond it the join is a shuffle.
FEW_PLACES = 1_000_000
#: Bits of the bitmap of repeated anchors (8 MB, whatever the input): it only spares a join rows that it would drop.
BITMAP_BITS = 26


# -- suffix arrays -----------------------------------------------------------------------------------------------------


def lyndon_groups(text: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Group of each suffix, previous suffix in a lower group, and where each group begins in the suffix array.

    ``text`` ends with its only least symbol.
    """
    n = len(text)
    number = {c: k for k, c in enumerate(sorted(set(text)))}
    group = [number[c] for c in text]
    members: list[list[int]] = [[] for _ in number]
    for s, g in enumerate(group):
        members[g].append(s)
    size = [len(m) for m in members]
    lower = list(range(-1, len(members) - 1))
    higher = [*range(1, len(members)), -1]
    done = [False] * len(members)
    previous = [-1] * n
    g = len(members) - 1
    while g >= 0:
        count: dict[int, int] = {}
        most = 1
        own = members[g]
        if len(own) > size[g]:
            own = [s for s in own if group[s] == g]
        if len(own) > 1:
            own.sort()
        for s in own:
            p = s - 1
            while p >= 0:
                at = group[p]
                if at == g:  # a member of the same group: its pointer is known and is this one's too
                    p = previous[p]
                    break
                if not done[at]:
                    break
                p = previous[p]
            previous[s] = p
            if p >= 0:
                if p in count:
                    count[p] = k = count[p] + 1
                    if k > most:
                        most = k
                else:
                    count[p] = 1
        done[g] = True
        members[g] = []
        for times in range(most, 0, -1):
            moved: dict[int, list[int]] = {}
            for p, k in count.items():
                if k == times:
                    at = group[p]
                    if at in moved:
                        moved[at].append(p)
                    else:
                        moved[at] = [p]
            for at, some in moved.items():
                if len(some) < size[at]:
                    new, up = len(size), higher[at]
                    size[at] -= len(some)
                    size.append(len(some))
                    members.append(some)
                    done.append(False)
                    lower.append(at)
                    higher.append(up)
                    higher[at] = lower[up] = new
                    for p in some:
                        group[p] = new
        g = lower[g]
    begin, at, g = [0] * len(size), 0, number[text[-1]]
    while g >= 0:
        begin[g] = at
        at += size[g]
        g = higher[g]
    return group, previous, begin


def suffix_array(text: list[int]) -> list[int]:
    """The suffixes of ``text`` in order; its last symbol is its only least one."""
    group, previous, front = lyndon_groups(text)
    n = len(text)
    array, placed = [0] * n, [False] * n
    array[0] = n - 1
    placed[n - 1] = True
    for i in range(n):
        s = array[i] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            array[front[g]] = s
            front[g] += 1
            placed[s] = True
            s = previous[s]
    return array


def repeated_windows(parts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which windows of ``length`` bytes that lie within one part are equal: part, start in it, and a number for equal ones."""
    sizes = np.array([len(x) for x in parts])
    flat = np.frombuffer(b"".join(parts), np.uint8)
    starts = np.cumsum(sizes + 1) - sizes - 1
    text = np.ones(len(flat) + len(parts) + 1, np.int64)  # 1 parts the parts, 0 ends the text
    of = np.repeat(np.arange(len(parts)), sizes)
    text[np.arange(len(flat)) + of] = flat.astype(np.int64) + 2
    text[-1] = 0
    array = np.array(suffix_array(text.tolist()))
    part = np.searchsorted(starts, array, "right") - 1
    inside = array - starts[part]
    whole = inside + length <= sizes[part]
    array, part, inside = array[whole], part[whole], inside[whole]
    number = np.zeros(len(array), np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(flat, length) if len(array) else flat
    place = array - part  # in flat, which has no marks between the parts
    for at in range(1, len(array), 50_000):
        to = min(len(array), at + 50_000)
        rows = windows[place[at - 1 : to]]
        number[at:to] = (rows[1:] != rows[:-1]).any(axis=1)
    return part, inside, number.cumsum()


# -- anchors -----------------------------------------------------------------------------------------------------------


def _sums(raw: np.ndarray, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of byte x power of the base, and the powers of the inverse base, modulo 2^64."""
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    up, down = np.full(len(raw) + 1, base), np.full(len(raw) + 1, inverse)
    up[0] = down[0] = 1
    up, down = np.cumprod(up), np.cumprod(down)
    return np.concatenate(([np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1]))), down


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def anchors(texts: list[bytes], only: np.ndarray | None = None, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """For each anchor: doc (place in ``texts``), h (hash of its gram), c (hash of its owned bytes), lo (where they begin) and n (how many windows it owns).

    ``only`` is a bitmap of hashes; with it other anchors are left out, and without it c is. All texts together have fewer
    than 2^PLACE_BITS bytes.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    if len(raw) >= 1 << PLACE_BITS:
        raise ValueError(f"{len(raw)} bytes have places of more than {PLACE_BITS} bits")
    begin = np.cumsum(sizes) - sizes
    none = {k: np.zeros(0, np.int64) for k in ("doc", "h", "c", "lo", "n")}
    if len(raw) < length:
        return none
    sums, down = _sums(raw, GRAM_BASE)
    grams = _mixed((sums[gram:] - sums[:-gram]) * down[: len(raw) - gram + 1])
    # the upper bits decide, then the place: the leftmost of equal ones, wherever the window stands
    low = np.uint64((1 << PLACE_BITS) - 1)
    ranked = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    w = length - gram + 1
    blocks = np.concatenate((ranked, np.full(-len(ranked) % w, ~np.uint64(0)))).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    m = len(raw) - length + 1
    owner = (np.minimum(back[:m], ahead[w - 1 : w - 1 + m]) & low).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)[:m]
    whole = np.flatnonzero(np.arange(m) + length <= (begin + sizes)[doc])
    if not len(whole):
        return none
    owner, doc = owner[whole], doc[whole]
    new = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (doc[1:] != doc[:-1]))))
    n = np.diff(np.append(new, len(whole)))
    lo, at, doc = whole[new], owner[new], doc[new]
    if only is None:
        return {"doc": doc, "h": grams[at].view(np.int64), "lo": lo - begin[doc], "n": n}
    word, bit = grams[at] >> np.uint64(6) & np.uint64(len(only) - 1), grams[at] & np.uint64(63)
    seen = (only[word.astype(np.int64)] >> bit & np.uint64(1)).astype(bool)
    lo, at, doc, n = lo[seen], at[seen], doc[seen], n[seen]
    sums, down = _sums(raw, CLASS_BASE)
    own = (sums[lo + n - 1 + length] - sums[lo]) * down[lo]
    c = _mixed(own ^ _mixed((at - lo).astype(np.uint64) * np.uint64(1024) + n.astype(np.uint64)))
    return {"doc": doc, "h": grams[at].view(np.int64), "c": c.view(np.int64), "lo": lo - begin[doc], "n": n}


def _chunks(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of few megabytes (or one document)."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < batch.num_rows:
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), CHUNK_BYTES, "right")))
        yield batch.slice(at, n)
        at += n


def _bytes(column: pa.Array) -> list[bytes]:
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in column]


def _pieces(texts: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """Documents cut so that a cut is of about 2 x CHUNK_BYTES; cuts overlap by a window less a byte, so each window lies in one."""
    for k, t in enumerate(texts):
        step = 2 * CHUNK_BYTES
        for at in range(0, max(1, len(t) - LENGTH + 1), step):
            yield k, at, t[at : at + step + LENGTH - 1]


def _runs(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """The pieces of documents in runs whose places fit ``PLACE_BITS``."""
    run, size = [], 0
    for piece in _pieces(texts):
        if run and size + len(piece[2]) >= 1 << PLACE_BITS:
            yield run
            run, size = [], 0
        run.append(piece)
        size += len(piece[2])
    if run:
        yield run


def _counts(docs: DataFrame) -> DataFrame:
    """``h, n``: the anchors of each part of a batch, and how often (two stands for more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(batch, 2):
                found = [anchors([t for _, _, t in cut])["h"] for cut in _runs(_bytes(part.column(2)))]
                h, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.minimum(n, 2))], ["h", "n"])

    return docs.mapInArrow(run, "h long, n long")


def _bitmap(twice: DataFrame) -> np.ndarray:
    """A bit for each value of the low bits of the hashes. Of fixed size, so it may pass through the driver."""
    word = F.shiftright("h", 6).bitwiseAND(F.lit((1 << BITMAP_BITS - 6) - 1))
    bit = F.expr("shiftleft(1L, cast(h & 63 as int))")
    rows = twice.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << BITMAP_BITS - 6, np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def _occurrences(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """A row for each anchor that the bitmap knows: h, c, id, tie, lo, n."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(batch, 2):
                for cut in _runs(_bytes(part.column(2))):
                    found = anchors([t for _, _, t in cut], shared.value)
                    of = np.array([k for k, _, _ in cut], np.int64)[found["doc"]]
                    lo = found["lo"] + np.array([at for _, at, _ in cut], np.int64)[found["doc"]]
                    ids = [part.column(i).take(pa.array(of)) for i in (0, 1)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found["h"]), pa.array(found["c"]), *ids, pa.array(lo), pa.array(found["n"].astype(np.int32))], ["h", "c", "id", "tie", "lo", "n"]
                    )

    return docs.mapInArrow(run, "h long, c long, id long, tie long, lo long, n int")


# -- the operator ------------------------------------------------------------------------------------------------------


def _stretches(ids: np.ndarray, ties: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """``id, tie, a, b`` that cover the windows at these places, those that start side by side or at one place in one row."""
    order = np.lexsort((at, ties, ids))
    ids, ties, at = ids[order], ties[order], at[order]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(ids) != 0) | (np.diff(ties) != 0) | (np.diff(at) > 1)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(at))[: len(begin)] - 1
    return pa.RecordBatch.from_arrays([pa.array(ids[begin]), pa.array(ties[begin]), pa.array(at[begin]), pa.array(at[end] + LENGTH)], ["id", "tie", "a", "b"])


def _contested_spans(reps: DataFrame) -> DataFrame:
    """Spans of ``h, id, tie, lo, owned`` that start earlier in another row of the same anchor, by suffix arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        size = 0

        def decided() -> pa.RecordBatch:
            part, inside, number = repeated_windows([r[4] for r in waiting])
            ids = np.array([r[1] for r in waiting], np.int64)[part]
            ties = np.array([r[2] for r in waiting], np.int64)[part]
            at = np.array([r[3] for r in waiting], np.int64)[part] + inside
            order = np.lexsort((at, ties, ids, number))
            first = np.concatenate(([True], np.diff(number[order]) > 0))
            return _stretches(*(x[order[~first]] for x in (ids, ties, at)))

        # rows come sorted by anchor; an array holds whole anchors
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size > ARRAY_BYTES and row[0] != waiting[-1][0]:
                    yield decided()
                    waiting, size = [], 0
                waiting.append(row)
                size += len(row[4])
        if waiting:
            yield decided()

    dealt = reps.select("h", "id", "tie", "lo", "owned").repartition("h").sortWithinPartitions("h")
    return dealt.mapInArrow(run, "id long, tie long, a long, b long")


def _crowded_spans(reps: DataFrame) -> DataFrame:
    """The same for anchors with very many rows: windows by 128-bit hash, the earliest of each stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, i, tie, lo, owned in zip(*(c.to_pylist() for c in batch.columns)):
                hashes = [hashlib.blake2b(owned[k : k + LENGTH], digest_size=16).digest() for k in range(len(owned) - LENGTH + 1)]
                n = len(hashes)
                yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array([i] * n), pa.array([tie] * n), pa.array(range(lo, lo + n), pa.int64())], ["w", "id", "tie", "a"])

    windows = reps.select("h", "id", "tie", "lo", "owned").mapInArrow(run, "w binary, id long, tie long, a long")
    first = windows.groupBy("w").agg(F.min(F.struct("id", "tie", "a")).alias("first"))
    return windows.join(first, "w").where(F.struct("id", "tie", "a") != F.col("first")).select("id", "tie", "a", (F.col("a") + LENGTH).alias("b"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``id, tie, a, b`` (bytes from a to b - 1) of ``id, tie, raw``: together they cover all that repeats."""
    twice = materialise(_counts(docs).groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"))
    seen = materialise(_occurrences(docs, _bitmap(twice)).join(twice, "h"))
    classes = materialise(seen.groupBy("h", "c").agg(F.min(F.struct("id", "tie", "lo", "n")).alias("rep"), F.count("*").alias("members")))
    again = classes.where("members > 1").select("h", "c", "rep")
    copies = seen.join(again, ["h", "c"]).where((F.col("id") != F.col("rep.id")) | (F.col("tie") != F.col("rep.tie")) | (F.col("lo") != F.col("rep.lo")))
    spans = copies.select("id", "tie", F.col("lo").alias("a"), (F.col("lo") + F.col("n") - 1 + LENGTH).alias("b"))
    several = classes.groupBy("h").agg(F.count("*").alias("classes")).where("classes > 1")
    places = materialise(classes.join(several, "h").select("h", "classes", "rep.*"))
    by_doc = places.groupBy("id", "tie").agg(F.collect_list(F.struct("h", "lo", "n", "classes")).alias("places"))
    owned = docs.join(F.broadcast(by_doc) if places.count() <= FEW_PLACES else by_doc, ["id", "tie"])
    reps = materialise(
        owned.select("id", "tie", "raw", F.explode("places").alias("p"))
        .select("p.h", "p.classes", "id", "tie", "p.lo", F.expr(f"substring(raw, cast(p.lo + 1 as int), p.n - 1 + {LENGTH})").alias("owned")).distinct()
    )
    return spans.union(_contested_spans(reps.where(F.col("classes") <= CROWD))).union(_crowded_spans(reps.where(F.col("classes") > CROWD)))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (the remaining bytes, one after the other) of every document.

    Documents go by id (null first), those with the same id by a hash of their text; rows with equal id and text are one
    document, and each gets its result. A null text has no bytes; an empty table gives no rows; texts of any length are
    taken whole; columns beyond the two named are not read.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    raw = docs.select(F.col(id_col).alias("doc_id"), key.alias("id"), F.xxhash64(text_col).alias("tie"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"))
    spans = repeated_spans(raw.select("id", "tie", "raw")).groupBy("id", "tie").agg(F.collect_set(F.struct("a", "b")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, some in zip(_bytes(batch.column(1)), batch.column(2).to_pylist()):
                merged: list[list[int]] = []
                for a, b in sorted((s["a"], s["b"]) for s in some or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                at, kept = 0, []
                for a, b in merged:
                    kept.append(text[at:a])
                    at = b
                kept.append(text[at:])
                out.append((len(text), sum(b - a for a, b in merged), len(merged), b"".join(kept)))
            if out:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(zip(*out), types))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = raw.join(spans, ["id", "tie"], "left").select("doc_id", "raw", "spans")
    return joined.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary")
