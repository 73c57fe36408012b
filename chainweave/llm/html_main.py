"""Main text of HTML pages: parser events, text-to-tag ratio per line, Gaussian smoothing and threshold clustering.

The standard library's event parser turns a page into lines, one for each block of text between block-level tags. Each
line has a ratio of its characters to the tags it took, and characters of links count for the tags. The ratios are smoothed along
the page by a Gaussian and split into two clusters at the threshold that parts them best. Lines form regions (what one
container holds between two others); a region whose smoothed ratio, weighted by characters, lies in the upper cluster
is content, and all its lines are, short ones too. Parts that a page itself marks as no content (menus, headers,
footers, sidebars, forms, scripts, adverts, notices, comments) are no lines at all, and where a page marks its article,
only the article's regions are asked.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Inline elements do not end a line.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
#: What never shows or never is article text.
DROPPED = frozenset(
    "script style head title template noscript iframe object svg canvas audio video nav aside footer form button select option textarea label dialog menu math map".split()
)
#: An open element of these ends where an article or a body part begins: it was not closed.
LEFT_OPEN = frozenset("nav aside header footer form p ul ol li a b i span".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
#: Words in class or id that mark a part as no content.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal "
    "overlay sidebar aside menu nav navbar navigation breadcrumb breadcrumbs header masthead footer comment comments disqus reply replies respond discussion "
    "share sharing social follow related recommended recommendations newsletter subscribe subscription signup login pagination pager toolbar widget tags "
    "skip search copyright disclaimer".split()
)
BESIDE = frozenset("has with without no".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLE = frozenset(("article", "main"))
SIGMA = 1.5
#: Share of a region's characters that links may hold.
MOST_LINKS = 0.5
_WORDS = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def marked(tag: str, attrs: dict[str, str | None]) -> bool:
    """Whether a page itself says that this element is no article text."""
    if tag in DROPPED or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return True
    if (attrs.get("role") or "").lower() in ROLES or _HIDDEN.search((attrs.get("style") or "").lower()):
        return True
    if tag in ("body", "html", "article", "main"):
        # a body or article is not thrown away for a word like "has-sidebar"; a comment marked up as an article is
        return tag == "article" and bool({"comment", "comments", "reply"} & set(_WORDS.findall((attrs.get("class") or "").lower())))
    named = " ".join(attrs.get(k) or "" for k in ("class", "id"))
    for name in named.split():
        words = _WORDS.findall(CAMEL.sub(" ", name).lower())
        # "has-sidebar" is the part beside the sidebar
        if words and words[0] not in BESIDE and not MARKS.isdisjoint(words):
            return True
    return False


class Lines(HTMLParser):
    """Collects lines: text, tags taken, characters in links, region, and which article they are in (0: none)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int, int]] = []  # tag, dropped here or above, region, article
        self.rows: list[tuple[str, int, int, int, int]] = []
        self.parts: list[str] = []
        self.tags = self.link_chars = self.regions = self.articles = 0

    def state(self) -> tuple[bool, int, int]:
        return self.open[-1][1:] if self.open else (False, 0, 0)

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            _, region, article = self.state()
            self.rows.append((text, self.tags, self.link_chars, region, article))
        if text or self.parts:
            self.tags = self.link_chars = 0
        self.parts = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.parts.append("\n")
        if tag not in INLINE and tag != "br":
            self.flush()
        self.tags += 1
        if tag in VOID:
            return
        if tag in ARTICLE or tag in ("footer", "body"):
            while self.open and self.open[-1][0] in LEFT_OPEN:
                self.open.pop()
        elif tag == "p" or tag in HEADINGS:
            self.close_to("p", within=INLINE)
        elif tag == "li":
            self.close_to("li", within=INLINE | {"p"})
        dropped, region, article = self.state()
        values = {k: v for k, v in reversed(attrs)}
        # a heading in the header of an article is a part of the article
        dropped = (dropped and not (tag in HEADINGS and article and self.open[-1][0] == "header")) or marked(tag, values)
        dropped = dropped or tag == "header"
        if tag not in INLINE and tag not in ("p", "br", "li", "tr", "td", "th", "dt", "dd") and tag not in HEADINGS:
            self.regions += 1
            region = self.regions
        if tag in ARTICLE and not marked(tag, values) and not any(x[0] in DROPPED for x in self.open):
            dropped = False  # a wrapper's name does not outweigh a marked article
        if tag in ARTICLE and not article and not dropped:
            self.articles += 1
            article = self.articles
        self.open.append((tag, dropped, region, article))

    def close_to(self, tag: str, within: frozenset[str]) -> None:
        """Close an open ``tag`` if nothing but ``within`` is open inside it."""
        k = len(self.open) - 1
        while k >= 0 and self.open[k][0] in within:
            k -= 1
        if k >= 0 and self.open[k][0] == tag:
            del self.open[k:]

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            return
        if tag not in INLINE:
            self.flush()
        self.tags += 1
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break
            if tag in INLINE and self.open[k][0] not in INLINE:
                break  # an inline end tag does not end blocks

    def handle_data(self, data: str) -> None:
        if self.state()[0]:
            return
        self.parts.append(data)
        if any(x[0] == "a" for x in self.open[-4:]):
            self.link_chars += len(data.strip())


def smoothed(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; the kernel is cut off at three sigma, and what lies beyond the ends of the page does not weigh."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weigh = lambda x: np.convolve(x, kernel)[reach : reach + len(x)]
    return weigh(values) / weigh(np.ones(len(values)))


def threshold(values: np.ndarray) -> float:
    """The cut that parts values into two clusters with the least squares within; below the least value if all are equal."""
    v = np.sort(values)
    if v[0] == v[-1]:
        return v[0] - 1
    n, total = np.arange(1, len(v)), np.cumsum(v)
    between = (total[:-1] / n - (total[-1] - total[:-1]) / (len(v) - n)) ** 2 * n * (len(v) - n)
    between[v[1:] == v[:-1]] = -1
    k = int(between.argmax())
    return (v[k] + v[k + 1]) / 2


def main_text(html: str) -> str:
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    rows = parser.rows
    if not rows:
        return ""
    chars = np.array([len(r[0]) for r in rows], float)
    links = np.array([min(r[2], len(r[0])) for r in rows], float)
    ratio = np.log1p((chars - links) / (1 + np.array([r[1] for r in rows])))
    soft = smoothed(ratio)
    cut = threshold(soft)
    # a region is a run of lines of one container, or a whole article
    groups: dict[tuple[int, int], list[int]] = {}
    for i, r in enumerate(rows):
        groups.setdefault((r[4], 0) if r[4] else (0, r[3]), []).append(i)
    inside = {k: g for k, g in groups.items() if k[0]}
    asked = inside or groups
    score = {k: float(np.average(soft[g], weights=chars[g])) for k, g in asked.items()}
    size = {k: chars[g].sum() for k, g in asked.items()}
    largest = max(size, key=lambda k: (size[k], -k[0], -k[1]))
    linked = {k: links[g].sum() / size[k] for k, g in asked.items()}
    chosen = {k for k in asked if score[k] > cut and linked[k] <= MOST_LINKS or k == largest}
    return " ".join(rows[i][0] for i in sorted(i for k in chosen for i in asked[k]))


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), text_name: str = "text") -> DataFrame:
    """The columns in ``keep``, the main text, and ``n_chars``, its code points.

    A null or empty page, or one without content, has an empty text; repeated rows give repeated rows; an empty table gives
    no rows; columns that are not named are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py() or "") for h in batch.column(len(keep))]
            columns = [*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))])

    kinds = [pages.schema[c].dataType.simpleString() for c in keep] + ["string", "bigint"]
    return pages.select(*keep, html_col).mapInArrow(run, ", ".join(f"c{i} {k}" for i, k in enumerate(kinds))).toDF(*keep, text_name, "n_chars")
