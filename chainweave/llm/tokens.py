"""Token ids of whole Arrow string columns by the ``tokenizers`` library, each distinct piece encoded once.

A byte-level pre-tokenizer always starts a new piece at a blank that a non-blank follows, so a text is cut there by
Arrow, the cuts are dictionary-encoded, and only pieces not met before go to the library's model; a stretch of letters alone is one piece. Texts with
characters about which regular-expression engines might disagree, or with the name of an added token, are given to the
library whole.
"""

from __future__ import annotations

import functools
import itertools
import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

DEFAULT_TOKENIZER = "byte_bpe_50k.json"
#: The pieces of the byte-level pre-tokenizer (fixed by the vocabulary file).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Outside these characters (ASCII without controls, Latin letters, general punctuation) a text is encoded whole.
UNUSUAL = r"[^\x09\x0A\x20-\x7E\x{A1}-\x{AC}\x{AE}-\x{17F}\x{2010}-\x{2015}\x{2018}-\x{201F}\x{2026}\x{20AC}]"
#: Blanks that do not stand alone between two words.
LOOSE = r" [ \t\n]|[\t\n ] | $|^ "
#: Entries and bytes of a worker's memory of pieces, and of stretches between blanks; each starts anew when full, which changes no result.
MEMORY = 600_000
MEMORY_BYTES = 80_000_000
#: Bytes of text that are cut up at once.
CHARS_AT_ONCE = 4_000_000


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    """The place of a public tokenizer file; an absolute path is taken as it is."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def load(name: str = DEFAULT_TOKENIZER):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name))


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 itself, the rest from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = (b for b in range(256) if b not in set(shown))
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def worker_encoder(name: str = DEFAULT_TOKENIZER, end_id: int | None = 0) -> Encoder:
    """The encoder of this worker process; what it remembers serves the tasks that follow."""
    return Encoder(name, end_id)


class Encoder:
    """Encodes without special tokens and appends ``end_id`` to every text; a null text is an empty one."""

    def __init__(self, name: str = DEFAULT_TOKENIZER, end_id: int | None = 0):
        import json

        import regex

        self.tokenizer = load(name)
        state = json.loads(self.tokenizer.to_str())
        step = state.get("pre_tokenizer") or {}
        self.byte_level = (
            step.get("type") == "ByteLevel"
            and not step.get("add_prefix_space")
            and step.get("use_regex", True)
            and state.get("normalizer") is None
            and state["model"]["type"] == "BPE"
        )
        added = [x["content"] for x in state.get("added_tokens", [])]
        self.added = "|".join(map(regex.escape, added)) if added else None
        self.find = regex.compile(PIECES).findall
        self.letters = byte_letters()
        self.end = [] if end_id is None else [end_id]
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.piece_bytes = self.chunk_bytes = 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids + self.end, np.uint32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets (one more than texts) and the ids of all texts, one after the other."""
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        ids, counts = [], []
        sizes = np.asarray(pc.binary_length(texts))
        at = 0
        while at < len(texts):
            more = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), CHARS_AT_ONCE, "right")))
            n, flat = self._slice(texts.slice(at, more))
            counts.append(n)
            ids.append(flat)
            at += more
        offsets = np.concatenate([[0], *counts]).astype(np.int64).cumsum()
        return offsets, np.concatenate(ids) if ids else np.zeros(0, np.uint32)

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = np.asarray(pc.match_substring_regex(texts, UNUSUAL)) | (not self.byte_level)
        if self.added:
            odd |= np.asarray(pc.match_substring_regex(texts, self.added.replace("\\|", "[|]").replace("\\<", "<").replace("\\>", ">")))
        loose = ~odd & np.asarray(pc.match_substring_regex(texts, LOOSE))
        plain = np.flatnonzero(~odd & ~loose)
        parts: list = [None] * len(texts)
        for i in np.flatnonzero(odd):
            parts[i] = self.whole(texts[int(i)].as_py())
        for i in np.flatnonzero(loose):
            found = self.find(texts[int(i)].as_py())
            self._learn(found)
            parts[i] = np.append(np.frombuffer(b"".join(map(self.pieces.__getitem__, found)), np.uint32), np.array(self.end, np.uint32))
        n, flat = self._plain(texts.take(pa.array(plain))) if len(plain) else (np.zeros(0, np.int64), np.zeros(0, np.uint32))
        if len(plain) == len(texts):
            return n, flat
        for i, a, b in zip(plain, np.cumsum(n) - n, np.cumsum(n)):
            parts[i] = flat[a:b]
        return np.array([len(x) for x in parts], np.int64), np.concatenate(parts)

    def _learn(self, found: list[str]) -> None:
        """Make sure that each of the pieces is in memory."""
        new = [x for x in set(found) if x not in self.pieces]
        if len(self.pieces) + len(new) > MEMORY or self.piece_bytes > MEMORY_BYTES:
            self.pieces, self.piece_bytes = {}, 0
            new = list(set(found))
        # at most an id of four bytes for each letter, and what the entry itself takes
        self.piece_bytes += sum(5 * len(x) + 160 for x in new)
        self.pieces.update(zip(new, map(self._piece, new)))

    def _piece(self, x: str) -> bytes:
        """The ids of one piece by the model. Only the blank has another letter among printable ASCII."""
        shown = x.replace(" ", "\u0120") if x.isascii() and x.isprintable() else x.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.split_pattern(texts, " ")
        flat = lists.flatten().dictionary_encode()
        codes = np.asarray(flat.indices).astype(np.int64)
        words: list[str] = flat.dictionary.to_numpy(zero_copy_only=False).tolist()
        starts = np.asarray(lists.offsets)[:-1] - lists.offsets[0].as_py()
        ends = np.append(starts[1:], len(codes))
        # the first cut of a text has no blank before it: such cuts get words of their own
        first = codes[starts]
        heads, where = np.unique(first, return_inverse=True)
        codes[starts] = len(words) + where
        wanted = [" " + w for w in words] + [words[i] for i in heads]
        known = list(map(self.chunks.get, wanted))
        missing = [i for i, x in enumerate(known) if x is None]
        if self.chunk_bytes > MEMORY_BYTES:
            self.chunks, self.chunk_bytes = {}, 0
        self.chunk_bytes += sum(5 * len(wanted[i]) + 160 for i in missing)
        for at in range(0, len(missing), 100_000):
            some = missing[at : at + 100_000]
            if len(self.chunks) + len(some) > MEMORY:
                self.chunks, self.chunk_bytes = {}, 0
            # letters alone (after the blank) are one piece, remembered here only
            words_at = [i for i in some if wanted[i].removeprefix(" ").isalpha()]
            for i in words_at:
                known[i] = self.chunks[wanted[i]] = self._piece(wanted[i])
            some = [i for i in some if known[i] is None]
            cut = [self.find(wanted[i]) for i in some]
            self._learn(list(itertools.chain.from_iterable(cut)))
            for i, x in zip(some, cut):
                known[i] = self.chunks[wanted[i]] = b"".join(map(self.pieces.__getitem__, x))
        tail = np.array(self.end, np.uint32).tobytes()
        known.append(tail)
        lengths = np.fromiter(map(len, known), np.int64, len(known)) // 4
        pool = np.frombuffer(b"".join(known), np.uint32)
        begin = np.cumsum(lengths) - lengths
        # after the last cut of each text comes the end id
        order = np.insert(codes, ends, len(known) - 1)
        n = lengths[order]
        stop = np.cumsum(n)
        ids = pool[np.repeat(begin[order] - (stop - n), n) + np.arange(stop[-1])]
        last = ends + np.arange(1, len(ends) + 1) - 1  # places of the end ids in ``order``
        per_text = np.diff(np.concatenate([[0], stop[last]]))
        return per_text, ids
