"""Best-fit packing by hierarchical residuals.

Each task packs the pieces it reads by best fit, largest first. Sequences that are nearly full are final. The others are
items of the next round, as large as they are full: fewer tasks, each with the underfull sequences of several earlier
ones, pack them by best fit again. What moves between rounds is one row for an underfull sequence; texts and ids never
move. The rounds end when a round with one task is done, or when a round saves nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainweave.llm import tokens
from chainweave.llm.common import slices
from chainweave.session import materialise

CAPACITY = 2048
#: A sequence with at most this many free places is final.
SLACK = 8
#: Underfull sequences that one task packs at most in a round; more tasks are used beyond it.
ITEMS_A_TASK = 200_000
FAN_IN = 8
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, uid long"


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document of n ids: whole if it fits, else a shorter first piece and full ones."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity or capacity
    return [(0, head)] + [(at, capacity) for at in range(head, n, capacity)]


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, largest first. Bin and offset of each item, and the fill of each bin.

    ``free`` has a bit for each residual that some open bin has, so the tightest fit is one shift away.
    """
    bins, offsets, fill = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    free, of = 0, [[] for _ in range(capacity + 1)]
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = free >> size
        if fits:
            rest = size + ((fits & -fits).bit_length() - 1)
            b = of[rest].pop()
            if not of[rest]:
                free ^= 1 << rest
        else:
            rest, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        if rest > size:
            of[rest - size].append(b)
            free |= 1 << (rest - size)
    return bins, offsets, np.array(fill, np.int64)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
           tokenizer: str = tokens.DEFAULT_TOKENIZER, end_id: int = 0) -> DataFrame:
    """Encode whole texts (null: empty), end each with ``end_id``, and cut what is longer than a sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid, encoder = TaskContext.get().partitionId() << 40, None
        for batch in batches:
            encoder = encoder or tokens.worker_encoder(tokenizer, end_id)
            rows = []
            for some in slices(batch, 1):
                offsets, ids = encoder.encode(some.column(1))
                for doc_id, a, b in zip(some.column(0).to_pylist(), offsets.tolist(), offsets[1:].tolist()):
                    for k, (at, n) in enumerate(cuts(b - a, capacity)):
                        rows.append((doc_id, k, at, n, zlib.crc32(ids[a + at : a + at + n].astype("<u4").tobytes()), uid))
                        uid += 1
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), *[pa.int64()] * 4))],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "uid"],
                )

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, PIECES)


def _packed(items: DataFrame, capacity: int, level: int) -> DataFrame:
    """Pack ``uid, size`` within each task; adds the bin's id, the place in it and its fill."""
    schema = T.StructType([*items.schema, *(T.StructField(c, T.LongType()) for c in ("bin", "place", "fill"))])
    size_at = items.columns.index("size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # a bin's id: the round, the task, and a running number
        first = (level << 58) | (TaskContext.get().partitionId() << 36)
        got = [b for b in batches if b.num_rows]
        if got:
            whole = pa.Table.from_batches(got).combine_chunks()
            b, place, fill = best_fit(whole.column(size_at).to_numpy(), capacity)
            for name, column in (("bin", first + b), ("place", place), ("fill", fill[b])):
                whole = whole.append_column(name, pa.array(column, pa.int64()))
            yield from whole.to_batches(max_chunksize=50_000)

    return items.mapInArrow(run, schema)


def pack(items: DataFrame, capacity: int = CAPACITY, slack: int = SLACK) -> DataFrame:
    """Pack a table with ``size`` (1 to capacity) and a column ``uid`` unlike for all rows; adds sequence_id and offset.

    Equal sizes are placed in the order in which they are read. An empty table packs to an empty one.
    """
    spark = items.sparkSession
    base = materialise(_packed(items, capacity, 0))
    maps, level = [], 0
    under = base.where((F.col("place") == 0) & (F.col("fill") < capacity - slack)).select(F.col("bin").alias("uid"), F.col("fill").alias("size"))
    count, tasks = under.count(), max(1, base.rdd.getNumPartitions())
    while count > 1:
        level += 1
        tasks = max(-(-tasks // FAN_IN), -(-count // ITEMS_A_TASK))
        dealt = under.repartition(tasks, F.xxhash64("uid", F.lit(level)))
        step = materialise(_packed(dealt, capacity, level))
        maps.append(step.select(F.col("uid").alias("child"), F.col("bin").alias("parent"), F.col("place").alias("shift")))
        under = step.where((F.col("place") == 0) & (F.col("fill") < capacity - slack)).select(F.col("bin").alias("uid"), F.col("fill").alias("size"))
        bins = step.where("place = 0").count()
        left = under.count()
        if tasks == 1 or bins == count:
            break
        count = left
    out = base.withColumnsRenamed({"bin": "sequence_id", "place": "offset"}).drop("fill")
    for step in maps:
        out = (
            out.join(step, F.col("sequence_id") == F.col("child"), "left")
            .withColumn("sequence_id", F.coalesce("parent", "sequence_id"))
            .withColumn("offset", F.col("offset") + F.coalesce("shift", F.lit(0)))
            .drop("child", "parent", "shift")
        )
    return out


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                   slack: int = SLACK, tokenizer: str = tokens.DEFAULT_TOKENIZER, end_id: int = 0) -> DataFrame:
    """Pack documents into sequences of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece with the end id alone; repeated rows are packed each; an empty table gives no rows;
    null ids stay null; columns beyond the two named are not read.
    """
    cut = pieces(docs, id_col, text_col, capacity, tokenizer, end_id)
    packed = pack(cut.withColumn("size", F.col("length")), capacity, slack)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
