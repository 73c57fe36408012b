"""Periodic runs of words, by longest common extensions over a difference cover.

A run of period q that is at least 4q long holds a place i on the grid 0, 2q, 4q, ... at which the words from i and from i + q agree for
more than q words. Over all q the grids have about ``n/2 * ln n`` places (a harmonic sum). From such a place the run reaches as
far as the words from i and i + q agree forwards, and as far as those before them agree backwards.

How far two places agree (LCE) is answered by a difference cover: of every ``COVER`` consecutive places only those whose
remainder is in ``MEMBERS`` are sampled, and any two places are at the same distance, under ``COVER``, before sampled
places. So fewer than ``COVER`` words are compared, and the rest is the least common prefix between two ranks of the sorted
sampled suffixes, by a sparse table. Only the sampled suffixes are sorted, by doubling. Backwards the same holds for
the words in reverse order.

Several documents, about ``common.SLICE_BYTES`` of text, are worked on together: their words follow each other, each document
behind its own number, and nothing compares words of two. A longer document is worked on alone. Only documents with a
place that agrees up to its sampled places have suffixes sorted.

A null text has no words; repeated rows are each worked on; a null id stays null; an empty table gives no rows. Columns named
in ``keep`` are handed on, others are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainweave.llm.common import slices

#: A perfect difference set (fixed value): every remainder of 31 is a difference of two members.
COVER = 31
MEMBERS = (1, 5, 11, 24, 25, 27)
#: A run is at least so many words, and so many of its periods, long.
LEAST_WORDS = 6
LEAST_PERIODS = 4
#: So many places of the grids are worked on at once.
PAIRS = 1_000_000
RUNS = "array<struct<start:long,length:long,period:long>>"


def _shifts() -> np.ndarray:
    """For remainders a and b: the least distance at which a + d and b + d are both members."""
    out = np.full((COVER, COVER), COVER, np.int64)
    member = np.zeros(COVER, bool)
    member[list(MEMBERS)] = True
    for d in range(COVER - 1, -1, -1):
        both = np.roll(member, -d)
        out[np.ix_(both, both)] = d
    return out


SHIFT = _shifts()


def _ranked(keys: np.ndarray) -> np.ndarray:
    """Ranks from 1 of the keys; equal keys have one rank."""
    _, ranks = np.unique(keys, return_inverse=True)
    return ranks + 1


class Extensions:
    """How many words from i and from j on agree, for places of the same document.

    ``words`` are numbers from 0; ``ends`` gives for each place the end of its document, and ``own`` the documents (by place)
    whose suffixes are to be sorted.
    """

    def __init__(self, words: np.ndarray, ends: np.ndarray, own: np.ndarray):
        self.words, self.ends = words, ends
        n = len(words)
        places = np.arange(n)
        member = np.zeros(COVER, bool)
        member[list(MEMBERS)] = True
        at = places[own & member[places % COVER]]
        self.slot = np.full(n + 1, -1, np.int64)
        self.slot[at] = np.arange(len(at))
        self.at = at
        if not len(at):
            return
        # the first COVER words, two at a time, a document's number first; places behind a document's end are 0
        rank = np.searchsorted(ends[at], ends[at]) + 1
        most = int(words.max()) + 2
        tied = np.arange(len(at))
        for t in range(0, COVER, 2):
            pair = np.zeros(len(tied), np.int64)
            for k in (t, t + 1):
                p = at[tied] + k
                there = (p < ends[at[tied]]) & (k < COVER)
                pair = pair * most + np.where(there, words[np.minimum(p, n - 1)] + 1, 0)
            if float(len(at) + 1) * most * most >= 2**62:
                pair = _ranked(pair)
                key = rank[tied] * (len(tied) + 2) + pair
            else:
                key = rank[tied] * (most * most) + pair
            rank, tied = self._refined(rank, tied, key)
            if not len(tied):
                break
        # doubling: the word count that a rank speaks for, and the ranks at each level
        self.levels: list[tuple[int, np.ndarray]] = [(COVER, rank.copy())]
        reach = COVER
        while len(tied):
            p = at[tied] + reach
            behind = np.where(p < ends[at[tied]], rank[self.slot[np.minimum(p, n)]], 0)
            rank, tied = self._refined(rank, tied, rank[tied] * (len(at) + 2) + behind)
            reach *= 2
            self.levels.append((reach, rank.copy()))
        order = np.argsort(rank, kind="stable")
        self.rank = np.empty(len(at), np.int64)
        self.rank[order] = np.arange(len(at))
        lcp = self._adjacent(at[order[:-1]], at[order[1:]])
        self.table = [lcp]
        step = 1
        while 2 * step <= len(lcp):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    @staticmethod
    def _refined(rank: np.ndarray, tied: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """New ranks of the tied suffixes, and those that are still tied. A rank is the first place of its group in the order."""
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.ones(len(key), bool)
        new[1:] = sorted_key[1:] != sorted_key[:-1]
        group = np.cumsum(new) - 1
        sizes = np.bincount(group)
        old = rank[tied[order]]
        # within the places of one old rank, groups follow each other
        head = np.ones(len(key), bool)
        head[1:] = old[1:] != old[:-1]
        first_of_old = np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))
        first_of_new = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        rank = rank.copy()
        rank[tied[order]] = old + (first_of_new - first_of_old)
        return rank, tied[order][sizes[group] > 1]

    def _adjacent(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common prefixes of neighbours in the order: equal ranks from the longest reach down, then the last words."""
        got = np.zeros(len(i), np.int64)
        n = len(self.words)
        for reach, rank in reversed(self.levels):
            a, b = i + got, j + got
            inside = (a < self.ends[i]) & (b < self.ends[j])
            same = inside & (rank[self.slot[np.minimum(a, n)]] == rank[self.slot[np.minimum(b, n)]])
            # equal ranks at documents' ends speak for the words that are left there, which differ in number
            got += np.where(same & (a + reach <= self.ends[i]) & (b + reach <= self.ends[j]), reach, 0)
        return got + self._compared(i + got, j + got, np.full(len(i), COVER), self.ends[i], self.ends[j])

    def _compared(self, i, j, most, end_i, end_j) -> np.ndarray:
        """How many of at most ``most`` words agree, word by word."""
        got = np.zeros(len(i), np.int64)
        active = np.flatnonzero(most > 0)
        while len(active):
            a, b = i[active] + got[active], j[active] + got[active]
            fits = (a < end_i[active]) & (b < end_j[active])
            active, a, b = active[fits], a[fits], b[fits]
            active = active[self.words[a] == self.words[b]]
            got[active] += 1
            active = active[got[active] < most[active]]
        return got

    def shifted(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distance to the next sampled places and how many of the words before them agree."""
        d = SHIFT[i % COVER, j % COVER]
        return d, self._compared(i, j, d, self.ends[i], self.ends[j])

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        d, got = self.shifted(i, j)
        go = np.flatnonzero((got == d) & (np.maximum(i, j) + d < self.ends[i]))
        if not len(go):
            return got
        a, b = self.rank[self.slot[i[go] + d[go]]], self.rank[self.slot[j[go] + d[go]]]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((hi - lo).astype(float))[1] - 1
        common = np.empty(len(go), np.int64)
        for k in np.unique(level):
            some = level == k
            row = self.table[k]
            common[some] = np.minimum(row[lo[some]], row[hi[some] - (1 << k)])
        got[go] += common
        return got


class _Finder:
    """Takes places of the grids whose first words agree, and prolongs ``PAIRS`` of them at once in both directions."""

    def __init__(self, words: np.ndarray, doc: np.ndarray, first: np.ndarray, ends: np.ndarray):
        self.words, self.doc, self.first, self.ends = words, doc, first, ends
        self.places, self.periods, self.held, self.out = [], [], 0, []
        self.plain = Extensions(words, ends, np.zeros(len(words), bool))
        self.sorted = {}

    def _extensions(self, way: str, i: np.ndarray) -> Extensions:
        """Suffixes are sorted once for each document that needs it, if all its places are asked about at once."""
        built, own = self.sorted.get(way, (None, np.zeros(self.doc[-1] + 1, bool)))
        if built is None or not own[self.doc[i]].all():
            own[self.doc[i]] = True
            of = own[self.doc]
            if way == "ahead":
                built = Extensions(self.words, self.ends, of)
            else:  # place p is n - 1 - p in reverse order
                built = Extensions(self.words[::-1], len(self.words) - self.first[::-1], of[::-1])
            self.sorted[way] = built, own
        return built

    def ask(self, i: np.ndarray, q: int) -> None:
        if len(i):
            self.places.append(i)
            self.periods.append(np.full(len(i), q))
            self.held += len(i)
            if self.held >= PAIRS:
                self._prolong()

    def _prolong(self) -> None:
        if not self.held:
            return
        i, q = np.concatenate(self.places), np.concatenate(self.periods)
        self.places, self.periods, self.held = [], [], 0
        d, got = self.plain.shifted(i, i + q)
        stays = (got == d) | (got > q)
        i, q = i[stays], q[stays]
        if not len(i):
            return
        ahead = self._extensions("ahead", i)(i, i + q)
        i, q, ahead = i[ahead > q], q[ahead > q], ahead[ahead > q]
        before = np.zeros(len(i), np.int64)
        inner = np.flatnonzero(i > self.first[i])
        if len(inner):  # the words before place p begin at n - p in reverse order
            n = len(self.words)
            before[inner] = self._extensions("back", i[inner])(n - i[inner] - q[inner], n - i[inner])
        start, length = i - before, before + q + ahead
        fits = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
        self.out.append(np.unique(np.stack((start[fits], length[fits], q[fits])), axis=1))

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and period; a run may come under multiples of its period too."""
        self._prolong()
        start, length, q = np.concatenate(self.out, axis=1) if self.out else np.zeros((3, 0), np.int64)
        return start, length, q


def find_runs(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, start (a word number in it), length and least period of every run, in that order; ``words`` of all documents in a row."""
    none = np.zeros(0, np.int64)
    words, sizes = words.astype(np.int64), sizes.astype(np.int64)
    n = len(words)
    starts = np.cumsum(sizes) - sizes
    if not n or sizes.max() < LEAST_WORDS:
        return none, none, none, none
    doc = np.repeat(np.arange(len(sizes)), sizes)
    finder = _Finder(words, doc, np.repeat(starts, sizes), np.repeat(starts + sizes, sizes))
    # grids by period: a document has a grid of period q if it can hold a run of it
    for q in range(1, int(sizes.max()) // LEAST_PERIODS + 1):
        of = np.flatnonzero(sizes >= max(LEAST_WORDS, LEAST_PERIODS * q))
        counts = (sizes[of] - q - 1) // (2 * q) + 1
        jump = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        i = np.repeat(starts[of], counts) + 2 * q * jump
        finder.ask(i[words[i] == words[i + q]], q)
    start, length, q = finder.found()
    order = np.lexsort((q, length, start))
    start, length, q = start[order], length[order], q[order]
    # the same stretch under a multiple of its period is no run of its own
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, q = start[new], length[new], q[new]
    order = np.lexsort((q, start))
    start, length, q = start[order], length[order], q[order]
    return doc[start], start - starts[doc[start]], length, q


def _split(column: pa.Array) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Each text's words, their numbers (all texts in a row), and how many a text has."""
    texts = [(x or b"").split() for x in column.cast(pa.large_binary()).to_pylist()]
    flat = pa.array([w for text in texts for w in text], pa.binary()).dictionary_encode()
    return texts, flat.indices.to_numpy().astype(np.int64), np.array([len(x) for x in texts], np.int64)


def _by_document(docs: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(docs, np.arange(n + 1))


def _rows(df: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *keep)


def with_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n_words, runs`` and the columns to keep: every run of each whole text, by start, then period.

    A run is a stretch of words with least period q (words q apart are equal) and a length of at least ``max(6, 4q)`` that neither neighbour
    prolongs. Words are numbered from 0.
    """
    rows = _rows(docs, id_col, text_col, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            for some in slices(batch, 1):
                _, words, sizes = _split(some.column(1))
                doc, start, length, period = find_runs(words, sizes)
                values = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(_by_document(doc, len(sizes)), pa.int32()), values).cast(kind)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sizes), lists, *some.columns[2:]], ["doc_id", "n_words", "runs", *keep])

    kept = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    return rows.mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}{kept}")


def collapsed(words: list[bytes], start: list[int], length: list[int], period: list[int]) -> bytes:
    """The words with blanks between, without those that any run holds after its first period."""
    if not start:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.add(start, period), 1)
    np.add.at(edge, np.add(start, length), -1)
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()])


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text``: of every run only its first period stays; words are joined by one blank."""
    rows = _rows(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 1):
                texts, words, sizes = _split(some.column(1))
                doc, start, length, period = find_runs(words, sizes)
                at = _by_document(doc, len(sizes))
                left = [collapsed(x, start[a:b].tolist(), length[a:b].tolist(), period[a:b].tolist()).decode() for x, a, b in zip(texts, at, at[1:])]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(left, pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What ``with_runs`` and ``collapse_runs`` give, as counts, the run with the greatest exponent and checksums, in one pass."""
    rows = _rows(docs, id_col, text_col)
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from fractions import Fraction

        for batch in batches:
            for some in slices(batch, 1):
                texts, words, sizes = _split(some.column(1))
                doc, *found = find_runs(words, sizes)
                at = _by_document(doc, len(sizes)).tolist()
                start, length, period = (x.tolist() for x in found)
                out = []
                for x, a, b in zip(texts, at, at[1:]):
                    own = range(a, b)
                    lines = b"".join(b"%d,%d,%d\n" % (start[k], length[k], period[k]) for k in own)
                    best = min(own, key=lambda k: (-Fraction(length[k], period[k]), start[k], period[k]), default=None)
                    shown = (None,) * 4 if best is None else (start[best], length[best], period[best], 1000 * length[best] // period[best])
                    left = collapsed(x, start[a:b], length[a:b], period[a:b])
                    out.append((b - a, *shown, hashlib.sha256(lines).hexdigest(), hashlib.sha256(left).hexdigest()))
                kinds = [pa.int64()] * 5 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array(c, t) for c, t in zip(zip(*out), kinds))], names)

    return rows.mapInArrow(run, ", ".join(f"{c} {'string' if c.endswith('sha256') else 'long'}" for c in names))
