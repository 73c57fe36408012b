"""Quality rules by distribution divergence.

A document's histogram of character classes and its histogram of the language's common words are compared with those of
all text in its language by the Jensen-Shannon distance (the root of the divergence to base 2, so 0 to 1). The references
are counted over the whole corpus. A short document has a ragged histogram, so each test has a least length; a language
with too little text is no reference. A document that is far from its own language's reference is compared with the other
languages before it is rejected, since the label may be wrong. Where there is no reference of a document's own language,
far from all others says nothing, and the base rules alone decide.
"""

from __future__ import annotations

import itertools
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainweave.llm.common import slices
from chainweave.session import materialise

CLASSES = ("lower", "upper", "other letter", "digit", "blank", "line end", "stop", "punctuation", "symbol")
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\r\x0b\x0c"
#: Common words of a language that have a place of their own in the histogram; all others share one.
COMMON = 50
#: Distances beyond which a document is rejected, and the words it needs for the test to be made.
CHAR_LIMIT, CHAR_WORDS = 0.22, 50
WORD_LIMIT, WORD_WORDS = 0.36, 100
#: Words of a language in the corpus from which it is a reference.
REFERENCE_WORDS = 10_000
MIN_WORDS = 50
#: Distinct words that a task counts before it hands the counts on.
COUNTED = 60_000
#: Most languages with a reference: labels are a closed list, and a column that is none must not reach the driver.
MOST_LANGUAGES = 10_000


def _classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, 8, np.uint8)
    by_category = {"Ll": 0, "Lu": 1, "Lt": 1, "Lm": 2, "Lo": 2, "Mn": 2, "Mc": 2, "Nd": 3, "Nl": 3, "No": 3, "Zs": 4, "Zl": 5, "Zp": 5}
    for i in range(0x110000):
        c = unicodedata.category(chr(i))
        k = by_category.get(c)
        if k is None and c[0] == "P":
            k = 7
        if k is not None:
            out[i] = k
    out[[9, 11, 12]] = 4
    out[[10, 13]] = 5
    out[[ord("."), ord(",")]] = 6
    out[list(SYMBOLS)] = 8
    return out


_TABLE: list[np.ndarray] = []


def char_histogram(text: str) -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_classes())
    return np.bincount(_TABLE[0][np.frombuffer(text.encode("utf-32-le"), np.uint32)], minlength=len(CLASSES))


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms; 0 if one is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(0.0, d / 2)))


def repeat_words(words: list[bytes]) -> int:
    """How many words lie in a window of three words that the text has twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    pairs = ids[:-1] * len(number) + ids[1:]
    if len(number) > 2_000_000:  # keep the next product within 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, of, n = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    again = n[of] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            n += bool(line.strip(BLANKS))
        else:
            seen.add(line)
    return n


def references(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> dict[str | None, tuple[np.ndarray, list[bytes], np.ndarray]]:
    """By language: class counts, common words, and their counts with those of all other words last, over all documents.

    Tasks count before the shuffle. The driver gets the class counts and ``COMMON`` words of each language.
    """

    def counts_of(words: dict[str | None, Counter], chars: dict[str | None, np.ndarray]) -> pa.RecordBatch:
        langs, kinds, keys, counts = [], [], [], []
        for lang, found in words.items():
            langs += [lang] * (len(found) + len(CLASSES))
            kinds += [1] * len(found) + [0] * len(CLASSES)
            keys += [*found, *(str(k).encode() for k in range(len(CLASSES)))]
            counts += [*found.values(), *chars[lang].tolist()]
        return pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(kinds, pa.int32()), pa.array(keys, pa.binary()), pa.array(counts, pa.int64())],
            ["lang", "kind", "key", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str | None, Counter] = {}
        chars: dict[str | None, np.ndarray] = {}
        for batch in batches:
            for some in slices(batch, 1):
                for lang, text in zip(some.column(0).to_pylist(), some.column(1)):
                    text = text.as_py()
                    if text:
                        words.setdefault(lang, Counter()).update(text.encode().lower().split())
                        chars[lang] = chars.get(lang, 0) + char_histogram(text)
                if sum(map(len, words.values())) > COUNTED:
                    yield counts_of(words, chars)
                    words, chars = {}, {}
        yield counts_of(words, chars)

    counted = materialise(
        docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
        .mapInArrow(run, "lang string, kind int, key binary, n long")
        .groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    )
    # only languages with enough words go on, and they must be few enough for the driver
    total = counted.where("kind = 1").groupBy("lang").agg(F.sum("n").alias("n")).where((F.col("n") >= REFERENCE_WORDS) & F.col("lang").isNotNull())
    total = materialise(total)
    if total.count() > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages: {lang_col} is no language column")
    order = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "key")
    # the limit is applied in each task before the shuffle
    fit = counted.join(total.select("lang"), "lang", "left_semi")
    top = fit.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= COMMON).select("lang", "kind", "key", "n")
    got = top.union(total.select("lang", F.lit(2).alias("kind"), F.lit(b"").alias("key"), "n")).collect()
    out: dict = {}
    rows_of: dict = {}
    for r in got:
        rows_of.setdefault(r.lang, []).append(r)
    for lang, own in rows_of.items():
        chars = np.zeros(len(CLASSES))
        for r in own:
            if r.kind == 0:
                chars[int(r.key)] = r.n
        words = sorted((-r.n, bytes(r.key)) for r in own if r.kind == 1)
        all_words = sum(r.n for r in own if r.kind == 2)
        counts = [-n for n, _ in words]
        out[lang] = (chars, [w for _, w in words], np.array([*counts, all_words - sum(counts)], float))
    return out


def verdict(text: str, words: list[bytes], lang: str | None, refs: dict) -> tuple[float | None, float | None, bool]:
    """Class and word distance to the language (to the nearest one if that is too far or unknown), and whether the text is kept.

    Only a language with a reference of its own can reject.
    """
    chars, counts, best = char_histogram(text), Counter(words), None
    for own in ([lang] if lang in refs else []) + [x for x in refs if x != lang]:
        ref_chars, common, ref_words = refs[own]
        found = np.array([counts[w] for w in common], float)
        c = distance(chars, ref_chars)
        w = distance(np.append(found, len(words) - found.sum()), ref_words)
        good = (len(words) < CHAR_WORDS or c <= CHAR_LIMIT) and (len(words) < WORD_WORDS or w <= WORD_LIMIT)
        if good:
            return c, w, True
        best = min(best or (c, w), (c, w), key=sum)
    return (*best, lang not in refs) if best else (None, None, True)


RULES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, char_distance double, word_distance double, kept boolean"
)


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """The id, the columns in ``keep``, the base counts, both distances and the verdict of every document.

    A null or empty text has no words and fails; for a null language, or one without enough text, the base
    alone decides, and the distances are those to the nearest reference, if there is any; repeated rows are judged each, alike; an empty table gives no
    rows; other columns are not read.
    """
    refs = references(docs, lang_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in itertools.chain.from_iterable(slices(x, 0) for x in batches):
            rows = []
            langs = batch.column(sent.index(lang_col)).to_pylist()
            for text, lang in zip(batch.column(0), langs):
                text = text.as_py() or ""
                raw = text.encode()
                words = raw.split()
                n, again = len(words), repeat_words(words)
                failed = n < MIN_WORDS or 100 * again > 50 * n
                c, w, good = (None, None, False) if failed else verdict(text, raw.lower().split(), lang, refs)
                rows.append((n, len(text) - sum(raw.count(x) for x in BLANKS), sum(raw.count(x) for x in SYMBOLS), dup_lines(raw), again, failed, c, w, good))
            if rows:
                types = (*[pa.int64()] * 5, pa.bool_(), pa.float64(), pa.float64(), pa.bool_())
                columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), types)]
                kept = [batch.column(at) for at in shown]
                yield pa.RecordBatch.from_arrays([*kept, *columns], [f"c{i}" for i in range(len(kept) + len(columns))])

    # a column that is both judged and kept crosses to the workers once
    sent = list(dict.fromkeys((text_col, lang_col, id_col, *keep)))
    shown = [sent.index(c) for c in (id_col, *keep)]
    source = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(sent)))
    names = [id_col, *keep, *(x.strip().split(" ")[0] for x in RULES.split(","))]
    kinds = [docs.schema[c].dataType.simpleString() for c in (id_col, *keep)] + [x.strip().split(" ")[1] for x in RULES.split(",")]
    schema = ", ".join(f"c{i} {k}" for i, k in enumerate(kinds))
    return source.mapInArrow(run, schema).toDF(*names)
