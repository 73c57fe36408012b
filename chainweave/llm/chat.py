"""Chat formatting with offset-aligned masks.

A conversation is rendered whole: ``<|im_start|>`` role ``<|im_sep|>`` text ``<|im_end|>`` per turn, in order. The whole
rendering is encoded once with offsets. Turn spans and token spans are both sorted, so binary search finds the tokens
that a turn covers; those of assistant texts are under the loss mask. The marks are added tokens, which no other token
crosses, so the mask never takes in a part of a mark or of another turn.

A control string inside a text or role cannot end a turn: wherever ``<``, any number of backslashes and ``|`` follow one
another, one backslash more is put in, and reading takes one out. So the marks' ``<|`` stands in a rendering only where the
template put it, and the turns can be read back from the rendering alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainweave.llm import tokens

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Roles whose texts are learned.
LEARNED = ("assistant",)
_RISKY, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(SEP) + "(.*?)" + re.escape(END), re.DOTALL)
FORMATTED = "conv_id long, formatted string, ids array<int>, token_start array<int>, token_end array<int>, loss_mask array<boolean>"


def escaped(text: str) -> str:
    return _RISKY.sub(r"<\\\1|", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def rendered(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The rendering and the span of the text of each turn in it, in characters."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = START + escaped(role) + SEP, escaped(text)
        parts += head, body, END
        spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def turns_of(formatted: str) -> list[tuple[str, str, int, int]]:
    """Role, text and the span of the (escaped) text of every turn, read back from a rendering."""
    return [(unescaped(m[1]), unescaped(m[2]), m.start(2), m.end(2)) for m in _TURN.finditer(formatted)]


def masked(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """True for tokens that lie in one of the sorted spans: of each span, the tokens that end behind its start and start before its end."""
    mask = np.zeros(len(starts), bool)
    for a, b in spans:
        if a < b:
            mask[np.searchsorted(ends, a, "right") : np.searchsorted(starts, b, "left")] = True
    return mask


def text_under(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> list[tuple[int, int]]:
    """Maximal spans of characters under the mask; tokens that share a character (parts of its bytes) count it once."""
    spans: list[list[int]] = []
    for a, b in zip(starts[mask].tolist(), ends[mask].tolist()):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(b, spans[-1][1])
        elif a < b:
            spans.append([a, b])
    return [(a, b) for a, b in spans]


def chat_tokenizer(name: str):
    """The tokenizer with the marks as added tokens and offsets that keep blanks."""
    from tokenizers import AddedToken
    from tokenizers.pre_tokenizers import ByteLevel

    t = tokens.load(name)
    t.add_special_tokens([AddedToken(x, normalized=False, special=True) for x in (START, SEP, END)])
    t.pre_tokenizer = ByteLevel(add_prefix_space=False, trim_offsets=False)
    return t


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", tokenizer: str = tokens.DEFAULT_TOKENIZER, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """One row a conversation: the rendering, its ids with the span of each, and the loss mask.

    Turns go by turn number (null first), then role and text, so ties and repeated rows have one order; a null role or text
    is an empty one; rows with a null conversation id are one conversation; an empty table gives no rows; columns beyond
    the four named are not read. A conversation is one row of the output and so must fit into a task, as it must at a reader.
    """
    turns = rows.groupBy(F.col(conv_col).cast("long").alias("conv_id")).agg(
        F.sort_array(F.collect_list(F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text")))).alias("turns")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = None
        for batch in batches:
            t = t or chat_tokenizer(tokenizer)
            for at in range(0, batch.num_rows, 200):
                some = batch.slice(at, 200)
                made = [rendered([(x["role"], x["text"]) for x in conv]) for conv in some.column(1).to_pylist()]
                roles = [[x["role"] for x in conv] for conv in some.column(1).to_pylist()]
                out = []
                for (text, spans), who, e in zip(made, roles, t.encode_batch([m[0] for m in made], add_special_tokens=False)):
                    offsets = np.array(e.offsets, np.int32).reshape(-1, 2)
                    mask = masked(offsets[:, 0], offsets[:, 1], [s for s, r in zip(spans, who) if r in learned])
                    out.append((text, e.ids, offsets[:, 0], offsets[:, 1], mask))
                types = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_()))
                names = ["conv_id", "formatted", "ids", "token_start", "token_end", "loss_mask"]
                columns = [pa.array(list(c), k) for c, k in zip(zip(*out), types)] if out else []
                if out:
                    yield pa.RecordBatch.from_arrays([some.column(0), *columns], names)

    return turns.mapInArrow(run, FORMATTED)


def digests(formatted: DataFrame) -> DataFrame:
    """What the output says, read back from it: turns from the rendering, learned text from the mask and the spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at in range(batch.num_rows):
                conv, text, _, starts, ends, mask = (c[at] for c in batch.columns)
                text = text.as_py()
                turns = turns_of(text)
                spans = text_under(text, *(np.asarray(x.values.to_numpy(zero_copy_only=False)) for x in (starts, ends, mask)))
                # texts that touch no other: each maximal span is one escaped text
                loss = "".join(unescaped(text[a:b]) for a, b in spans)
                told = hashlib.sha256("".join(f"{r}\n{x}\n" for r, x, _, _ in turns).encode()).hexdigest()
                out.append((conv.as_py(), len(turns), told, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            if out:
                types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), k) for c, k in zip(zip(*out), types)],
                    ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
                )

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
