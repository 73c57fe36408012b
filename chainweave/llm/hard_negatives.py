"""Hard negatives of anchors by integer inner products, with bounds along a spanning tree of anchors.

Anchors are dealt into blocks of like label, and each block gets a minimum spanning tree. Against a block of candidates the
root's scores are computed; a child's score lies within (edge length x candidate's norm) of its parent's, which gives an
interval for every candidate without a product. Only candidates whose interval meets the window that is asked about are
rescored; the others pass their wider interval on to the next children. Nothing is approximate: an interval that misses the
window proves that the score does.

There are two rounds. The first asks for an anchor's best rows of its own label (its positives): the window is open
above and begins at the k-th best lower bound. The second asks for rows of other labels in the windows that the positives set, and
raises each window's lower end to the k-th best score found there.

Anchors are a stated query set; a task meets one slice of anchor blocks with one slice of candidate blocks, of bounded
size both, and what it returns is at most k rows an anchor and window. No label, however frequent, is gathered anywhere.

Rows with a null id, label or vector, an empty vector, or a component that is null or not finite take no part. Rows equal in id, label
and vector count once; an anchor never meets rows with its own id; rows that share an id but differ otherwise are rows
of their own. Vectors meet vectors of their own length only. Ties go to the smaller id. An empty table gives no rows; columns
beyond the three named are not read. Scores must fit in 64 bits; otherwise an error is raised.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainweave.session import materialise

SCALE = 256
#: Anchors of a tree, candidates of a block, blocks of a task.
TREE = 256
BLOCK = 4096
SLICE = 16
PAIRS = "anchor_no long, anchor_id long, positive_no int, positive_id long, positive_score long, other_id long, other_score long, other_label int, rescored long, met long"


def prepared(vectors: DataFrame, id_col: str, vec_col: str, label: Column, scale: int) -> DataFrame:
    """``vec_id, label, v``: rows that take part, each once, with components ``floor(scale * x)``."""
    x = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("int").alias("label"), x.alias("x")).dropna()
    fine = (F.size("x") > 0) & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    # a float keeps what a long could not hold; integers are exact there up to 2**53
    return rows.where(fine).select("vec_id", "label", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v")).distinct()


def packed(rows: DataFrame, most: int) -> DataFrame:
    """Blocks of at most ``most`` rows whose vectors have one length: ``block, dim, n, ids, labels, v`` (numbers of eight bytes each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: dict[int, list] = {}

        def out(dim: int) -> pa.RecordBatch:
            nonlocal number
            ids, labels, v = (np.concatenate(x) for x in zip(*held.pop(dim)))
            number += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32()),
                 *(pa.array([x.astype(np.int64).tobytes()], pa.binary()) for x in (ids, labels, v))],
                ["block", "dim", "n", "ids", "labels", "v"],
            )

        for batch in batches:
            sizes = np.array([len(x) for x in batch.column(2)])
            for dim in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == dim))
                ids, labels = (part.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                v = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim)
                at = 0
                while at < len(ids):
                    have = sum(len(x[0]) for x in held.get(dim, []))
                    end = min(len(ids), at + most - have)
                    held.setdefault(dim, []).append((ids[at:end], labels[at:end], v[at:end]))
                    at = end
                    if have + held[dim][-1][0].size == most:
                        yield out(dim)
        for dim in list(held):
            yield out(dim)

    return rows.select("vec_id", "label", "v").mapInArrow(run, "block long, dim int, n int, ids binary, labels binary, v binary")


def spanning_tree(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Parent (-1: root) and edge length of each anchor of a minimum spanning tree, and the anchors by depth."""
    v = v.astype(float)
    n = len(v)
    parent, edge, depth = np.full(n, -1), np.zeros(n), np.zeros(n, int)
    near, of = np.full(n, np.inf), np.zeros(n, int)
    open_ = np.ones(n, bool)
    at = 0
    for _ in range(n - 1):
        open_[at] = False
        d = np.sqrt(((v - v[at]) ** 2).sum(1))
        closer = open_ & (d < near)
        near[closer], of[closer] = d[closer], at
        at = int(np.argmin(np.where(open_, near, np.inf)))
        parent[at], edge[at], depth[at] = of[at], near[at], depth[of[at]] + 1
    return parent, edge, [np.flatnonzero(depth == k) for k in range(depth.max() + 1)] if n else []


def exact(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of ``a`` with those of ``x``; floats hold them exactly as long as they stay under 2**53."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(x).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(float) @ x.astype(float).T).astype(np.int64)
    found = a.astype(object) @ x.astype(object).T
    if any(abs(s) >= 2**63 for s in found.ravel()):
        raise ArithmeticError("scores do not fit in 64 bits")
    return found.astype(np.int64)


class Bounds:
    """Intervals of the scores of a tree's anchors with a block of candidates, narrowed to exact scores where a window asks for them."""

    def __init__(self, anchors: np.ndarray, parent: np.ndarray, edge: np.ndarray, x: np.ndarray):
        self.anchors, self.parent, self.x = anchors, parent, x
        # a little more than the product, so that rounding never makes an interval too narrow
        self.slack = edge[:, None] * (np.sqrt((x.astype(float) ** 2).sum(1)) * (1 + 1e-9)) + 1e-3
        shape = (len(anchors), len(x))
        self.low, self.high = np.empty(shape), np.empty(shape)
        self.score = np.zeros(shape, np.int64)
        self.known = np.zeros(shape, bool)
        self.rescored = 0

    def inherit(self, of: np.ndarray) -> None:
        """Intervals of the anchors from those of their parents; the root's are open."""
        up = self.parent[of]
        root = (up < 0)[:, None]
        self.low[of] = np.where(root, -np.inf, self.low[up] - self.slack[of])
        self.high[of] = np.where(root, np.inf, self.high[up] + self.slack[of])

    def rescore(self, of: np.ndarray, wanted: np.ndarray) -> None:
        """Exact scores where ``wanted`` (anchors x candidates) says so."""
        if wanted.sum() * 4 > wanted.size:  # one product of two matrices is dearer a score only where few are wanted
            found = exact(self.anchors[of], self.x)
        else:
            found = np.zeros(wanted.shape, np.int64)
            for k in np.flatnonzero(wanted.any(1)):
                found[k, wanted[k]] = exact(self.anchors[of[k]][None], self.x[wanted[k]])[0]
        # margins that rounding to a float cannot leave
        about = found.astype(float)
        room = np.abs(about) * 1e-15
        self.score[of] = found
        self.known[of] = wanted
        self.low[of] = np.where(wanted, about - room, self.low[of])
        self.high[of] = np.where(wanted, about + room, self.high[of])
        self.rescored += int(wanted.sum())


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties by id."""
    if len(scores) > 4 * k + 64:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        fine = np.flatnonzero(scores >= edge)
        return fine[np.lexsort((ids[fine], -scores[fine]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _unpacked(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels, v = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels", "v"))
    return ids, labels, v.reshape(len(ids), -1)


def _trees(anchors: pd.DataFrame) -> Iterator[tuple]:
    """A tree's anchors, in the order of their numbers, with parents, edges and levels."""
    for _, own in anchors.groupby("tree"):
        own = own.sort_values("place")
        parent, edge = own["parent"].to_numpy(), own["edge"].to_numpy()
        yield own, np.stack(own["v"]).astype(np.int64), parent, edge, [np.flatnonzero(own["depth"].to_numpy() == d) for d in sorted(own["depth"].unique())]


def _positives(k: int):
    """For each anchor of a slice the k best rows of its label in a slice of candidates."""

    def run(anchors: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        out = []
        for own, a, parent, edge, levels in _trees(anchors):
            own_ids, own_labels = own["vec_id"].to_numpy(), own["label"].to_numpy()
            kept: list[list] = [[] for _ in range(len(a))]
            rescored = met = 0
            for _, row in blocks.iterrows():
                if row["dim"] != a.shape[1]:
                    continue
                ids, labels, x = _unpacked(row)
                use = np.isin(labels, own_labels)
                ids, labels, x = ids[use], labels[use], x[use]
                if not len(ids):
                    continue
                bounds = Bounds(a, parent, edge, x)
                for of in levels:
                    bounds.inherit(of)
                    mine = (labels == own_labels[of][:, None]) & (ids != own_ids[of][:, None])
                    met += int(mine.sum())
                    # the k-th best lower bound of this block, or the k-th best score so far, whichever is greater
                    low = np.where(mine, bounds.low[of], -np.inf)
                    least = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] >= k else np.full(len(of), -np.inf)
                    so_far = np.array([kept[n][k - 1][0] if len(kept[n]) >= k else -np.inf for n in of], float)
                    bounds.rescore(of, mine & (bounds.high[of] >= np.maximum(least, so_far * (1 - np.sign(so_far) * 1e-15))[:, None]))
                    for n in of:
                        there = np.flatnonzero(bounds.known[n])
                        best = there[_best(bounds.score[n, there], ids[there], k)]
                        merged = kept[n] + list(zip(bounds.score[n, best].tolist(), ids[best].tolist()))
                        kept[n] = sorted(merged, key=lambda e: (-e[0], e[1]))[:k]
                rescored += bounds.rescored
            numbers = own["anchor_no"].tolist()
            rows = [(numbers[n], int(own_ids[n]), 0, 0, 0, i, s, int(own_labels[n]), 0, 0) for n in range(len(a)) for s, i in kept[n]]
            if rows:
                rows[0] = (*rows[0][:-2], rescored, met)
            out += rows
        return pd.DataFrame(out, columns=[c.split()[0] for c in PAIRS.split(", ")])

    return run


def _negatives(k: int, least: int, most: int):
    """For each anchor and positive of a slice the k best rows of other labels in the positive's window in a slice of candidates."""

    def run(anchors: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        out = []
        for own, a, parent, edge, levels in _trees(anchors):
            own_ids, own_labels = own["vec_id"].to_numpy(), own["label"].to_numpy()
            positives = [[(p["id"], p["score"]) for p in (x if x is not None else ())] for x in own["positives"]]
            # integers s with least * p <= 100 * s <= most * p
            windows = [[(-(-least * p // 100), most * p // 100) for _, p in x] for x in positives]
            kept: list[list[list]] = [[[] for _ in x] for x in positives]
            rescored = met = 0
            for _, row in blocks.iterrows():
                if row["dim"] != a.shape[1]:
                    continue
                ids, labels, x = _unpacked(row)
                bounds = Bounds(a, parent, edge, x)
                for of in levels:
                    bounds.inherit(of)
                    other = (labels != own_labels[of][:, None]) & (ids != own_ids[of][:, None])
                    met += int(other.sum())
                    wanted = np.zeros(other.shape, bool)
                    for at, n in enumerate(of):
                        for (low, high), found in zip(windows[n], kept[n]):
                            # rows under the k-th best so far cannot enter any more; a tie can, by its id
                            low = max(low, found[k - 1][0]) if len(found) >= k else low
                            if low <= high:
                                room = 1e-15 * max(abs(low), abs(high))
                                wanted[at] |= (bounds.high[n] >= low - room) & (bounds.low[n] <= high + room)
                    bounds.rescore(of, wanted & other)
                    for n in of:
                        there = np.flatnonzero(bounds.known[n])
                        scores = bounds.score[n, there]
                        for which, (low, high) in enumerate(windows[n]):
                            fits = np.flatnonzero((scores >= low) & (scores <= high))
                            best = fits[_best(scores[fits], ids[there[fits]], k)]
                            merged = kept[n][which] + list(zip(scores[best].tolist(), ids[there[best]].tolist(), labels[there[best]].tolist()))
                            kept[n][which] = sorted(merged, key=lambda e: (-e[0], e[1], e[2]))[:k]
                rescored += bounds.rescored
            numbers = own["anchor_no"].tolist()
            rows = [
                (numbers[n], int(own_ids[n]), which, *positives[n][which], i, s, label, 0, 0)
                for n in range(len(a)) for which in range(len(positives[n])) for s, i, label in kept[n][which]
            ]
            if rows:
                rows[0] = (*rows[0][:-2], rescored, met)
            out += rows
        return pd.DataFrame(out, columns=[c.split()[0] for c in PAIRS.split(", ")])

    return run


def forest(anchors: DataFrame, tree: int = TREE) -> DataFrame:
    """``tree, place, anchor_no, vec_id, label, v, parent, edge, depth``: anchors in blocks of like label with a spanning tree each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, labels, v = _unpacked(row)
                parent, edge, levels = spanning_tree(v)
                depth = np.zeros(len(ids), int)
                for d, of in enumerate(levels):
                    depth[of] = d
                place = np.arange(len(ids))
                flat = pa.array(v.ravel())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), row["block"])), pa.array(place), pa.array(row["block"] * tree + place), pa.array(ids), pa.array(labels),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * v.shape[1], pa.int32()), flat), pa.array(parent), pa.array(edge), pa.array(depth)],
                    ["tree", "place", "anchor_no", "vec_id", "label", "v", "parent", "edge", "depth"],
                )

    like = anchors.repartitionByRange("label", F.xxhash64("v")).sortWithinPartitions("label")
    return packed(like, tree).mapInArrow(
        run, "tree long, place long, anchor_no long, vec_id long, label long, v array<long>, parent long, edge double, depth long"
    )


def mine(vectors: DataFrame, is_anchor: Column, k_positive: int = 5, k_negative: int = 5, least: int = 80, most: int = 100,
         label: Column | None = None, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score, anchor_label, negative_label``.

    Of each row for which ``is_anchor`` (over ``vec_id``) holds, and each of the ``k_positive`` best other rows of its label, the ``k_negative``
    best rows of other labels whose score is at least ``least`` and at most ``most`` per cent of the positive's.
    """
    rows = materialise(prepared(vectors, id_col, vec_col, F.col("label") if label is None else label, scale))
    blocks = materialise(packed(rows, BLOCK))
    trees = materialise(forest(rows.where(is_anchor)))
    n_trees, n_blocks = trees.where("place = 0").count(), blocks.count()
    # slices of trees and of blocks: every pair of slices is one task
    down, across = max(1, -(-n_trees // 2)), max(1, -(-n_blocks // SLICE))
    all_blocks = (
        blocks.withColumn("c", F.pmod(F.xxhash64("block"), F.lit(across)).cast("int"))
        .withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    )

    def met(anchors: DataFrame, run) -> DataFrame:
        spread = (
            anchors.withColumn("a", F.pmod(F.xxhash64("tree"), F.lit(down)).cast("int"))
            .withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
        )
        return spread.groupBy("a", "c").cogroup(all_blocks.groupBy("a", "c")).applyInPandas(run, PAIRS)

    order = (F.desc("other_score"), "other_id", "other_label")
    first = Window.partitionBy("anchor_no").orderBy(*order)
    best = met(trees, _positives(k_positive)).withColumn("n", F.row_number().over(first)).where(F.col("n") <= k_positive)
    entry = F.struct(F.col("n").alias("n"), F.col("other_id").alias("id"), F.col("other_score").alias("score"))
    positives = best.groupBy("anchor_no").agg(F.sort_array(F.collect_list(entry)).alias("positives"))
    asked = materialise(trees.join(positives, "anchor_no"))
    each = Window.partitionBy("anchor_no", "positive_no").orderBy(*order)
    found = met(asked, _negatives(k_negative, least, most)).withColumn("rank", F.row_number().over(each)).where(F.col("rank") <= k_negative)
    labels = trees.select("anchor_no", F.col("label").cast("int").alias("anchor_label"))
    return found.join(labels, "anchor_no").select(
        "anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score",
        F.col("other_score").alias("negative_score"), "anchor_label", F.col("other_label").alias("negative_label"),
    )
