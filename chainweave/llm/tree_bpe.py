"""Byte-pair encoding by a segment tree over the ranks of adjacent pairs, and decoding.

A leaf stands for a symbol and holds ``rank * n + place`` of the pair that the symbol forms with the one behind it, or ``n`` times
the number of merges where there is none; an inner node holds the least key below it. The root is therefore the leftmost of
the lowest-ranked merges. A merge changes three leaves (the pair itself, the one before it, and the symbol that goes), each in
logarithmic time, and a piece of n bytes is done after fewer than n merges, however long it is.

The vocabulary file gives normaliser, pre-tokenizer, merges and added tokens. No piece reaches over ASCII white space, so
a text is cut there and what was met before comes from a memory of cuts that is bounded in bytes; that changes no result.

A null text is an empty one and has no ids; repeated rows are each encoded; a null id stays null; an empty table gives no rows. Very
long texts are encoded whole. Columns named in ``keep`` are handed on, others are not read.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainweave.llm import tokens
from chainweave.llm.common import slices

DEFAULT_TOKENIZER = "word_bpe_49k.json"
#: Bytes of cuts and pieces, with their ids, beyond which a worker's memory of them starts anew.
MEMORY_BYTES = 64_000_000
#: Longer pieces have a tree of their own; shorter ones go in step with others of like length, so many at once.
WIDEST = 64
ROWS = 8192
#: How the pre-tokenizer cuts printable ASCII (fixed by the vocabulary file).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class PairTree:
    """The least key among pairs, by place, with updates in logarithmic time."""

    def __init__(self, keys: list[int], none: int):
        self.width = 1 << max(0, len(keys) - 1).bit_length()
        self.node = [none] * self.width + keys + [none] * (self.width - len(keys))
        for at in range(self.width - 1, 0, -1):
            self.node[at] = min(self.node[2 * at], self.node[2 * at + 1])

    def least(self) -> int:
        return self.node[1]

    def put(self, place: int, key: int) -> None:
        node, at = self.node, place + self.width
        node[at] = key
        while at > 1:
            other = node[at ^ 1]
            at >>= 1
            best = key if key < other else other
            if node[at] == best:
                return
            node[at] = key = best


@functools.lru_cache(maxsize=2)
def worker_coder(name: str = DEFAULT_TOKENIZER) -> Coder:
    """The coder of this worker process; what it remembers serves the tasks that follow."""
    return Coder(name)


class Coder:
    """Encodes without special tokens added and decodes as the tokenizer's file says."""

    def __init__(self, name: str = DEFAULT_TOKENIZER):
        import regex

        self.tokenizer = tokens.load(name)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        state = json.loads(self.tokenizer.to_str())
        model = state["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            raise ValueError(f"{name} is no plain byte-pair vocabulary")
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.pairs = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        self.merged = [self.vocab[a + b] for a, b in merges]
        self.merged_ids = np.array(self.merged, np.int32)
        keys = np.array([(a << 32) | b for a, b in self.pairs], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([rank for rank, _ in self.pairs.values()], np.int64)[order]
        own = json.dumps([state.get("normalizer"), state.get("pre_tokenizer")])
        plain = json.dumps(PIECES) in own and '"Lowercase"' in own and '"NFC"' in own
        self.find = regex.compile(PIECES).findall if plain else None
        self.added = {x["content"]: x["id"] for x in state.get("added_tokens", [])}
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in state.get("added_tokens", [])):
            raise ValueError(f"{name} has added tokens that are not matched as they stand")
        names = sorted(self.added, key=len, reverse=True)
        self.cut_added = regex.compile(b"(" + b"|".join(regex.escape(x.encode()) for x in names) + b")").split if names else None
        self.decoder = self.tokenizer.decoder
        size = 1 + max([*self.vocab.values(), *self.added.values()])
        self.texts = [b""] * size
        for text, i in (self.vocab | self.added).items():
            self.texts[i] = text.encode()
        self.numbers = [b"%d" % i for i in range(size)]
        self.memory: dict[bytes, bytes] = {}
        self.piece_memory: dict[str, bytes] = {}
        self.added_ids = {x.encode(): np.array([i], np.uint32).tobytes() for x, i in self.added.items()}
        self.held = 0

    def piece(self, piece: str) -> list[int]:
        """The ids of one piece of the pre-tokenizer, in the letters of its bytes."""
        known = self.vocab
        symbols = [known[c] for c in piece[:-1]] + [known[piece[-1] + self.suffix]]
        n = len(symbols)
        if n == 1:
            return symbols
        pairs, none = self.pairs, len(self.merged) * n
        tree = PairTree([pairs[p][0] * n + i if (p := (symbols[i], symbols[i + 1])) in pairs else none for i in range(n - 1)], none)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        while (key := tree.least()) < none:
            rank, at = divmod(key, n)
            gone = after[at]
            symbols[at] = self.merged[rank]
            alive[gone] = False
            after[at] = behind = after[gone]
            if gone < n - 1:
                tree.put(gone, none)
            if behind < n:
                before[behind] = at
                found = pairs.get((symbols[at], symbols[behind]))
                tree.put(at, found[0] * n + at if found else none)
            else:
                tree.put(at, none)
            if (left := before[at]) >= 0:
                found = pairs.get((symbols[left], symbols[at]))
                tree.put(left, found[0] * n + left if found else none)
        return [s for s, stays in zip(symbols, alive) if stays]

    def pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids, four bytes each, of many pieces; those of like length go through their trees in step."""
        out: list[bytes | None] = [None] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, x in enumerate(pieces):
            if len(x) > WIDEST:
                out[i] = np.array(self.piece(x), np.uint32).tobytes()
            else:
                by_width.setdefault(1 << (len(x) - 1).bit_length(), []).append(i)
        for width, places in by_width.items():
            for at in range(0, len(places), ROWS):
                some = places[at : at + ROWS]
                for i, ids in zip(some, self._in_step([pieces[i] for i in some], width)):
                    out[i] = ids
        return out

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or the number of merges where the two do not merge; -1 is no symbol."""
        wanted = (left.astype(np.int64) << 32) | right
        found = np.minimum(np.searchsorted(self.pair_keys, wanted), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[found] == wanted) & (left >= 0) & (right >= 0), self.pair_ranks[found], len(self.merged))

    def _in_step(self, pieces: list[str], width: int) -> list[bytes]:
        """One tree a row, with ``width`` leaves; each turn takes every row's root and makes that merge, until no row has one."""
        known, suffix = self.vocab, self.suffix
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = np.fromiter((known[c] if k else known[c + suffix] for x in pieces for k, c in zip(range(len(x) - 1, -1, -1), x)), np.int32, int(sizes.sum()))
        symbols = np.full((len(pieces), width + 1), -1, np.int32)
        symbols[:, :width][np.arange(width) < sizes[:, None]] = flat
        none = len(self.merged) * width
        node = np.full((len(pieces), 2 * width), none, np.int64)
        node[:, width:] = np.minimum(self._rank(symbols[:, :-1], symbols[:, 1:]) * width + np.arange(width), none)
        for at in range(width - 1, 0, -1):
            node[:, at] = np.minimum(node[:, 2 * at], node[:, 2 * at + 1])
        before = np.tile(np.arange(-1, width), (len(pieces), 1))
        after = np.tile(np.arange(1, width + 2), (len(pieces), 1))

        def put(rows: np.ndarray, place: np.ndarray, key: np.ndarray) -> None:
            at = place + width
            node[rows, at] = key
            while at.size and width > 1 and at[0] > 1:  # leaves are equally deep
                at = at >> 1
                node[rows, at] = np.minimum(node[rows, 2 * at], node[rows, 2 * at + 1])

        rows = np.flatnonzero(node[:, 1] < none)
        while rows.size:
            rank, at = np.divmod(node[rows, 1], width)
            gone = after[rows, at]
            behind = after[rows, gone]
            symbols[rows, at], symbols[rows, gone] = self.merged_ids[rank], -1
            after[rows, at], before[rows, behind] = behind, at
            put(rows, gone, np.full(len(rows), none))
            put(rows, at, np.minimum(self._rank(symbols[rows, at], symbols[rows, behind]) * width + at, none))
            has = np.flatnonzero(before[rows, at] >= 0)
            few, right = rows[has], at[has]
            left = before[few, right]
            put(few, left, np.minimum(self._rank(symbols[few, left], symbols[few, right]) * width + left, none))
            rows = rows[node[rows, 1] < none]
        stays = symbols >= 0
        ends = np.cumsum(stays.sum(1)) * 4
        ids = symbols[stays].astype(np.uint32).tobytes()
        return [ids[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]

    def _cut_pieces(self, cut: bytes) -> list[str]:
        """What the pre-tokenizer makes of a stretch without white space."""
        text = cut.decode()
        if self.find and cut.isascii() and text.isprintable():
            return self.find(text.lower())
        text = self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text
        return [piece for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def _learn(self, cuts: set[bytes]) -> None:
        """Make sure that each of the cuts is in memory."""
        memory, ids_of = self.memory, self.piece_memory
        new = [x for x in cuts if x not in memory]
        made = [self._cut_pieces(x) for x in new]
        missing = list({p for pieces in made for p in pieces if p not in ids_of})
        ids_of.update(zip(missing, self.pieces(missing)))
        # four bytes an id, at most one id a byte, and about 200 bytes for the entry itself
        self.held += sum(5 * len(x) + 200 for x in missing) + sum(5 * len(x) + 200 for x in new)
        for x, pieces in zip(new, made):
            memory[x] = ids_of[pieces[0]] if len(pieces) == 1 else b"".join([ids_of[p] for p in pieces])

    def encode_all(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """The ids of each text; what the texts share is worked out once."""
        if self.held > MEMORY_BYTES:
            self.memory, self.piece_memory, self.held = {}, {}, 0
        parts = [self.cut_added(x) if self.cut_added and x else [x or b""] for x in texts]
        cuts = [[part.split() if k % 2 == 0 else part for k, part in enumerate(own)] for own in parts]
        self._learn({c for own in cuts for part in own[::2] for c in part})
        ids_of, out = self.memory, []
        for own in cuts:
            found = [b"".join(map(ids_of.__getitem__, part)) if k % 2 == 0 else self.added_ids[part] for k, part in enumerate(own)]
            out.append(np.frombuffer(found[0] if len(found) == 1 else b"".join(found), np.uint32))
        return out

    def encode(self, text: bytes | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of the ids, special tokens included: the decoder's, or where the file has none, its tokens with blanks between."""
        if self.decoder is None:
            return b" ".join(map(self.texts.__getitem__, ids.tolist()))
        return self.decoder.decode([self.texts[i].decode() for i in ids.tolist() if self.texts[i]]).encode()


def _texts(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """``doc_id, ids`` and the columns to keep: the ids of every whole text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_coder(tokenizer)
        for batch in batches:
            for some in slices(batch, 1):
                found = coder.encode_all(_texts(some.column(1)))
                offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                ids = pa.array(np.concatenate(found).astype(np.int32))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(offsets, ids), *some.columns[2:]], ["doc_id", "ids", *keep])

    kept = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    return rows.mapInArrow(run, f"doc_id long, ids array<int>{kept}")


def decode(encoded: DataFrame, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """``doc_id, decoded`` of rows with ``doc_id, ids``; a null array is an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_coder(tokenizer)
        for batch in batches:
            texts = [coder.decode(np.array(x.as_py() or [], np.int64)).decode() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded string")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: what ``encode`` and ``decode`` give, as checksums, in one pass over the texts."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_coder(tokenizer)
        for batch in batches:
            for some in slices(batch, 1):
                counts, ids_sha, text_sha = [], [], []
                for ids in coder.encode_all(_texts(some.column(1))):
                    counts.append(len(ids))
                    ids_sha.append(hashlib.sha256(b" ".join(map(coder.numbers.__getitem__, ids.tolist()))).hexdigest())
                    text_sha.append(hashlib.sha256(coder.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return rows.mapInArrow(run, DIGESTS)
