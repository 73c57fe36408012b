"""Length-delimited binary records of token ids, with masked checksums and a separate offset index.

A shard is one file. A record is framed as

    length of the payload, 8 bytes | masked checksum of those 8 bytes, 4 bytes | payload | masked checksum of it, 4 bytes

all little-endian. The checksum is CRC-32, turned right by 15 bits and raised by ``MASK``, so that the checksum of data
which hold checksums stays useful. The payload is the document's id (8 bytes, signed; a flag tells a null), the width of
an id (2 or 4 bytes, whichever holds the largest id) and the ids. Shards hold ascending ranges of documents; the index
(shard, record, offset, length, doc_id, n_tokens) is a table of its own, so records can be read in any order by seeking.

Null text is an empty one; a null document id sorts first; rows with the same id sort by a hash of their text, and equal
rows are all kept; an empty table makes no shard and an empty index. Columns beyond the two named are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainweave.llm import tokens
from chainweave.llm.common import slices
from chainweave.session import materialise, shared_folder

#: Fixed value of the masked checksum.
MASK = 0xA282EAD8
HEAD = struct.Struct("<QI")
META = struct.Struct("<?qB")
INDEX = "shard int, record long, offset long, length long, doc_id long, n_tokens long"
READ = "shard int, record long, doc_id long, n_tokens long, before long, ids_crc32 long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def payload(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = len(ids) and int(ids.max()) > 0xFFFF
    return META.pack(doc_id is None, doc_id or 0, 4 if wide else 2) + ids.astype("<u4" if wide else "<u2").tobytes()


def unpacked(data: bytes) -> tuple[int | None, np.ndarray]:
    null, doc_id, width = META.unpack_from(data)
    return None if null else doc_id, np.frombuffer(data, f"<u{width}", offset=META.size).astype("<u4")


def frame(data: bytes) -> bytes:
    size = struct.pack("<Q", len(data))
    return b"".join((size, struct.pack("<I", masked(size)), data, struct.pack("<I", masked(data))))


def unframed(data, at: int = 0) -> tuple[bytes, int]:
    """The payload of the record that begins at ``at`` and the place behind it; damage raises an error."""
    if at + HEAD.size > len(data):
        raise ValueError(f"record cut off at byte {at}")
    size, crc = HEAD.unpack_from(data, at)
    if masked(bytes(data[at : at + 8])) != crc:
        raise ValueError(f"length of the record at byte {at} is damaged")
    begin, end = at + HEAD.size, at + HEAD.size + size
    got = bytes(data[begin:end])
    if len(got) != size or end + 4 > len(data) or masked(got) != struct.unpack_from("<I", data, end)[0]:
        raise ValueError(f"payload of the record at byte {at} is damaged")
    return got, end + 4


def file_system(folder: str):
    """The file system of a folder and the folder's path there."""
    from pyarrow import fs

    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def shard_name(shard: int) -> str:
    return f"shard-{shard:07d}.rec"


def write(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text",
          tokenizer: str = tokens.DEFAULT_TOKENIZER, end_id: int = 0) -> tuple[str, DataFrame]:
    """Encode the documents and write their shards in ascending order of id; the folder and the index.

    The shuffle carries the text, which is smaller than its ids, and a task encodes and writes what it reads, record
    by record. A shard is written under a name of its own and then renamed: a task that runs again writes the same.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark).rstrip('/')}/records-{uuid.uuid4().hex}"
    file_system(folder)[0].create_dir(file_system(folder)[1], recursive=True)
    dealt = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, out, at, record, encoder = TaskContext.get().partitionId(), None, 0, 0, None
        system, path = file_system(folder)
        own = f"{path}/.{uuid.uuid4().hex}"
        for batch in batches:
            if not batch.num_rows:
                continue
            encoder = encoder or tokens.worker_encoder(tokenizer, end_id)
            out = out or system.open_output_stream(own)
            rows = []
            for some in slices(batch, 1, tokens.CHARS_AT_ONCE):
                offsets, ids = encoder.encode(some.column(1))
                for doc_id, a, b in zip(some.column(0).to_pylist(), offsets, offsets[1:]):
                    out.write(data := frame(payload(doc_id, ids[a:b])))
                    rows.append((shard, record, at, len(data), doc_id, int(b - a)))
                    at, record = at + len(data), record + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.int64()] * 5))],
                ["shard", "record", "offset", "length", "doc_id", "n_tokens"],
            )
        if out:
            out.close()
            system.move(own, f"{path}/{shard_name(shard)}")

    return folder, materialise(dealt.mapInArrow(run, INDEX))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of every shard, checked: its document, its ids' count and checksum, and the ids before it in its shard."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.rec").load(folder).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data, at, before, rows = memoryview(content.as_buffer()), 0, 0, []
                shard = int(path.rsplit("shard-", 1)[1].split(".")[0])
                while at < len(data):
                    got, at = unframed(data, at)
                    doc_id, ids = unpacked(got)
                    rows.append((shard, len(rows), doc_id, len(ids), before, zlib.crc32(ids.tobytes())))
                    before += len(ids)
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.int64()] * 5))],
                        ["shard", "record", "doc_id", "n_tokens", "before", "ids_crc32"],
                    )

    return files.mapInArrow(run, READ)


def read_at(folder: str, shard: int, offset: int, length: int) -> tuple[int | None, list[int]]:
    """One record by its entry in the index, for reads in any order."""
    system, path = file_system(folder)
    with system.open_input_file(f"{path}/{shard_name(shard)}") as f:
        data, end = unframed(f.read_at(length, offset))
    doc_id, ids = unpacked(data)
    return doc_id, ids.tolist()


def with_starts(records: DataFrame, index: DataFrame) -> DataFrame:
    """Add how many ids all earlier documents have: the shards' totals (a row a shard) are summed up in shard order."""
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    upto = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("shard", F.coalesce(F.sum("total").over(upto), F.lit(0)).alias("base"))
    return records.join(base, "shard").withColumn("start", F.col("base") + F.col("before"))
