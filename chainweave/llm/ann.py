"""Approximate nearest neighbours by cross-polytope hashing.

A table turns unit vectors by three rounds of random signs and a fast Hadamard transform, and assigns each to the nearest
signed axis. A query looks into the buckets of the axes nearest to it in every table, and what it finds there is ranked
by the exact inner product. So that nearness by inner product is nearness of directions, vectors are divided by the
greatest norm and get one more component that makes them units (queries get a zero there).

How many axes a query probes is fitted: on at most ``SAMPLE`` vectors, the least number that finds the share ``TARGET`` of
the true neighbours among them. A larger table has nearer neighbours, so recall there is higher, not lower. Every
vector is indexed.

Equal vectors are one entry with its least ids, one more than a query returns, as ties go by id. Buckets are split
into blocks on both sides, so a bucket that holds a third of all vectors is many small tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainweave.session import materialise

TABLES = 4
SAMPLE = 4096
SAMPLE_QUERIES = 256
TARGET = 0.97
BLOCK = 4096
SEED = 9_176


def hadamard(rows: np.ndarray) -> np.ndarray:
    """The normalised fast Hadamard transform of each row; rows are a power of two long."""
    n, h = rows.shape[1], 1
    while h < n:
        pairs = rows.reshape(len(rows), -1, 2, h)
        rows = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(len(rows), n)
        h *= 2
    return rows / np.sqrt(n)


def axes(units: np.ndarray, table: int) -> np.ndarray:
    """How near each signed axis is to each unit vector in a table: twice as many columns as rotated components."""
    width = 1 << max(0, units.shape[1] - 1).bit_length()
    turned = np.pad(units, ((0, 0), (0, width - units.shape[1])))
    signs = np.random.default_rng([SEED, table, width]).choice([-1.0, 1.0], (3, width))
    for k in range(3):
        turned = hadamard(turned * signs[k])
    return np.concatenate((turned, -turned), axis=1)


def unit_entries(vectors: np.ndarray, longest: float) -> np.ndarray:
    scaled = vectors / longest
    return np.column_stack((scaled, np.sqrt(np.maximum(0, 1 - (scaled**2).sum(1)))))


def unit_queries(vectors: np.ndarray) -> np.ndarray:
    scale = np.abs(vectors).max(1, keepdims=True)
    scaled = vectors / scale
    return np.column_stack((scaled / np.linalg.norm(scaled, axis=1, keepdims=True), np.zeros(len(vectors))))


def fitted_probes(sample: np.ndarray, longest: float, k: int, tables: int = TABLES, target: float = TARGET) -> int:
    """The least number of axes a query probes in each table to find ``target`` of its k nearest in the sample."""
    if len(sample) < 2:
        return 1
    queries = sample[:SAMPLE_QUERIES]
    scores = queries @ sample.T
    scores[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
    top = np.argsort(-scores, axis=1)[:, : min(k, len(sample) - 1)]
    entries, asked, best = unit_entries(sample, longest), unit_queries(queries), None
    for t in range(tables):
        rank = np.argsort(np.argsort(-axes(asked, t), axis=1), axis=1)
        found = np.take_along_axis(rank, axes(entries, t).argmax(1)[top], axis=1)
        best = found if best is None else np.minimum(best, found)
    return int(np.quantile(best, target, method="higher")) + 1


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id, v`` of the rows that take part: an id, and a vector of finite components that are not all zero."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.size("v").__gt__(0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(fine)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _by_size(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose vectors have one length each."""
    import pyarrow.compute as pc

    n = pc.list_value_length(batch.column(at)).to_numpy()
    for size in np.unique(n):
        yield batch.filter(pa.array(n == size))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
            tables: int = TABLES, target: float = TARGET) -> DataFrame:
    """``query_id, rank, vec_id, score``: of each row of ``queries`` the k rows of ``vectors`` with the largest inner product.

    Vectors that are null, empty or zero, or hold a null or a component that is not finite, and rows without an id, take no
    part. A query meets vectors of its own length only, and never the row with its own id. Ids are taken to be unique;
    equal rows count once. Ties go to the smaller id. Empty tables give no rows; further columns are not read.
    """
    rows = usable(vectors, id_col, vec_col).distinct()
    least = Window.partitionBy("h", "v").orderBy("vec_id")
    entries = materialise(
        rows.withColumn("h", F.xxhash64("v")).withColumn("n", F.row_number().over(least)).where(F.col("n") <= k + 1)
        .groupBy("h", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    )
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    longest = entries.agg(F.max(norm)).first()[0] or 1.0
    sample = entries.orderBy("h").limit(SAMPLE).select("v").toPandas()["v"]
    sizes = sample.map(len)
    probes = max((fitted_probes(np.stack(sample[sizes == n]), longest, k, tables, target) for n in sizes.unique()), default=1)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_size(batch, 0):
                units = unit_entries(_matrix(part.column(0)), longest)
                for t in range(tables):
                    bucket = (t << 48) | (units.shape[1] << 24) | axes(units, t).argmax(1)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), *part.columns], ["bucket", "v", "ids"])

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_size(batch, 1):
                units = unit_queries(_matrix(part.column(1)))
                for t in range(tables):
                    near = axes(units, t)
                    found = np.argpartition(-near, min(probes, near.shape[1]) - 1, axis=1)[:, :probes]
                    of = pa.array(np.repeat(np.arange(len(units)), found.shape[1]))
                    bucket = (t << 48) | (units.shape[1] << 24) | found.ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), *(c.take(of) for c in part.columns)], ["bucket", "query_id", "v"])

    index = materialise(entries.select("v", "ids").mapInArrow(indexed, "bucket long, v array<double>, ids array<long>"))
    questions = materialise(usable(queries, id_col, vec_col).distinct())
    # at most tables x 2 x length rows
    filled = materialise(index.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("index_blocks")))

    def reranked(entries: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if entries.empty or queries.empty:
            return pd.DataFrame({"query_id": [], "ids": [], "scores": []})
        x, ids = np.stack(entries["v"]), entries["ids"].to_list()
        out_ids, out_scores = [], []
        for at in range(0, len(queries), 512):
            q = np.stack(queries["v"].iloc[at : at + 512])
            rough = q @ x.T
            n = min(len(x), k + 1)
            edge = np.partition(rough, len(x) - n, axis=1)[:, len(x) - n]
            # all that rounding in the blocked product could have put below the last wanted one, ties included
            room = 1e-12 * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max()
            for own, row, least, one in zip(queries["query_id"].iloc[at : at + 512], rough, edge - room, q):
                places = np.flatnonzero(row >= least)
                scores = (one * x[places]).sum(1)
                found = sorted((-s, int(i)) for s, p in zip(scores.tolist(), places.tolist()) for i in ids[p] if i != own)[:k]
                out_ids.append([i for _, i in found])
                out_scores.append([-s for s, _ in found])
        return pd.DataFrame({"query_id": queries["query_id"].to_list(), "ids": out_ids, "scores": out_scores})

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        found = {int(i): s for ids, scores in zip(rows["ids"], rows["scores"]) for i, s in zip(ids, scores)}
        best = sorted((-s, i) for i, s in found.items())[:k]
        return pd.DataFrame({"query_id": rows["query_id"].iloc[0], "rank": range(1, len(best) + 1), "vec_id": [i for _, i in best], "score": [-s for s, _ in best]})

    def ranked(asked: DataFrame) -> DataFrame:
        """What the asked buckets hold, ranked exactly for each query."""
        wanted = asked.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("query_blocks"))
        blocks = materialise(filled.join(wanted, "bucket"))
        left = (
            index.join(F.broadcast(blocks), "bucket").withColumn("i", F.pmod(F.xxhash64("ids"), "index_blocks"))
            .withColumn("j", F.explode(F.expr("sequence(0, query_blocks - 1)"))).select("bucket", "i", "j", "v", "ids")
        )
        right = (
            asked.join(F.broadcast(blocks), "bucket").withColumn("j", F.pmod(F.xxhash64("query_id"), "query_blocks").cast("int"))
            .withColumn("i", F.explode(F.expr("sequence(0L, index_blocks - 1L)"))).select("bucket", "i", "j", "v", "query_id")
        )
        lists = left.groupBy("bucket", "i", "j").cogroup(right.groupBy("bucket", "i", "j")).applyInPandas(
            reranked, "query_id long, ids array<long>, scores array<double>"
        )
        return lists.groupBy("query_id").applyInPandas(merged, "query_id long, rank int, vec_id long, score double")

    first = materialise(ranked(materialise(questions.mapInArrow(probed, "bucket long, query_id long, v array<double>"))))
    # a query whose buckets held too few looks into every bucket of one table, which holds all vectors of its length
    size = F.size("v")
    there = entries.groupBy(size.alias("d")).agg(F.sum(F.size("ids")).alias("there"))
    got = first.groupBy("query_id").agg(F.count("*").alias("got"))
    short = (
        questions.withColumn("d", size).join(got, F.col("vec_id") == F.col("query_id"), "left").join(there, "d")
        .where(F.coalesce("got", F.lit(0)) < F.least(F.lit(k), F.col("there") - 1))
    )
    table_of = filled.where(F.shiftright("bucket", 48) == 0).select("bucket", F.shiftright("bucket", 24).alias("units"))
    everywhere = materialise(
        short.join(table_of, F.col("units") == F.col("d") + 1).select("bucket", F.col("vec_id").alias("query_id"), "v")
    )
    if everywhere.isEmpty():
        return first
    return first.join(everywhere.select("query_id").distinct(), "query_id", "left_anti").unionByName(ranked(everywhere))
