"""HTML extraction: flat text blocks classified by a decision tree.

A page becomes a sequence of flat text blocks: block-level tags end a block, inline tags and <br> do not. Each
block is described by its word count and link density, those of the block before and after, and by where it stands: inside
an article, inside elements that hold no main text by name or by class, id or role (menus, headers, footers,
sidebars, notices, adverts, forms, reader comments; a part of a longer name such as ``entry-header`` is a feature of its
own), whether it is a heading or a list item. A decision tree (CART,
Gini) trained on the small labelled table of ``html_labels`` keeps or drops each block. Parsing is a per-page
helper; Spark spreads the pages.

Defined cases. Null or empty html, or a page without main text: empty text. A tag cut off at the end of the page is
dropped. Elements left open end with the page. White space inside a block becomes one space; character references
are decoded. Null or repeated page_ids: one result row for each row. Empty input: no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pairlab.llm import html_labels

#: Tags that stay inside a block, tags without text, void tags, tags and name parts that hold no main text.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
             "small span strike strong sub sup time tt u var wbr".split())
SILENT = set("script style noscript template head title iframe object svg math canvas select textarea button datalist "
             "audio video map".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BARE = set("nav footer aside form dialog menu".split())
HINTS = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar menu nav navbar navigation "
            "breadcrumb breadcrumbs cookie cookies consent gdpr popup newsletter subscribe social comments comment commentlist "
            "respond disqus pagination pager".split())
#: Name parts that hold no main text as a whole name only: "header", but not "entry-header".
LOOSE = set("banner side notice notices alert modal overlay signup login share sharing related recommended replies reply footer "
            "foot header masthead toolbar widget hidden".split())
#: Tags of a single block of text: a name says little there inside an article.
TEXT = set("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
ARTICLES = set("article main".split())
HEADINGS = {f"h{i}" for i in range(1, 7)}
FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "bare", "article", "heading", "item", "page_article", "weak"]
DEPTH, LEAF = 9, 5
_CUT = re.compile(r"<[a-zA-Z/!?][^<>]*$")


class Blocks(HTMLParser):
    """Collects (text, words, linked words, bare, article, heading, item, marked, weak) of every block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple] = []
        self.open: list[tuple[str, bool, bool, bool, bool, bool]] = []  # tag, silent, bare, article, marked, weak
        self.parts: list[str] = []
        self.linked = 0
        self.anchors = 0

    def _state(self) -> tuple[bool, bool, bool, bool, bool]:
        return self.open[-1][1:] if self.open else (False, False, False, False, False)

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            _, bare, article, marked, weak = self._state()
            tags = {t[0] for t in self.open}
            self.blocks.append((text, len(text.split()), self.linked, bare, article, bool(tags & HEADINGS), "li" in tags, marked, weak))
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            self.flush()
            if tag in ("p", "li", "tr", "td", "th", "dt", "dd", "option"):
                self._end_open(tag)
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        silent, bare, article, marked, weak = self._state()
        named = dict(attrs)
        names = f"{named.get('class') or ''} {named.get('id') or ''}".lower().split()
        parts = {x for n in names for x in re.split("[_-]+", n)}
        hinted = bool(parts & HINTS) or bool(set(names) & LOOSE)
        loose = bool(parts & LOOSE)
        if tag in ARTICLES or tag in ("body", "html"):
            hinted = loose = False
        elif article and tag in TEXT:
            hinted, loose = False, hinted or loose
        header = tag == "header" and not article
        self.anchors += tag == "a"
        self.open.append((tag, silent or tag in SILENT,
                          bare or header or hinted or tag in BARE
                          or (named.get("role") or "").lower() in ROLES or "hidden" in named or named.get("aria-hidden") == "true",
                          article or tag in ARTICLES or named.get("role") in ("main", "article"), marked or "data-main" in named, weak or loose))

    def _end_open(self, tag: str) -> None:
        """An element of these kinds ends an open one of the same kind in the same container."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self._pop(i)
                return
            if self.open[i][0] not in INLINE:
                return

    def _pop(self, i: int) -> None:
        self.anchors -= sum(t[0] == "a" for t in self.open[i:])
        del self.open[i:]

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.flush()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self._pop(i)
                return
            if tag in INLINE and self.open[i][0] not in INLINE:
                return

    def handle_data(self, data):
        if self._state()[0]:
            return
        self.parts.append(data)
        if self.anchors:
            self.linked += len(data.split())


def blocks(html: str) -> list[tuple]:
    parser = Blocks()
    parser.feed(_CUT.sub("", html))
    parser.close()
    parser.flush()
    return parser.blocks


def features(found: list[tuple]) -> np.ndarray:
    """One row for each block, columns as in FEATURES."""
    n = len(found)
    words = np.array([b[1] for b in found], float)
    links = np.minimum(np.array([b[2] for b in found], float) / np.maximum(words, 1), 1)
    flags = np.array([b[3:7] for b in found], float).reshape(n, 4)
    out = np.zeros((n, len(FEATURES)))
    out[:, 0], out[:, 1] = words, links
    out[1:, 2], out[1:, 3] = words[:-1], links[:-1]
    out[:-1, 4], out[:-1, 5] = words[1:], links[1:]
    out[:, 6:10] = flags
    # whether the page has an article outside the bare elements at all
    out[:, 10] = (flags[:, 1] * (1 - flags[:, 0])).max(initial=0)
    out[:, 11] = [b[8] for b in found]
    return out


def grow(x: np.ndarray, y: np.ndarray, depth: int = DEPTH) -> tuple:
    """A CART tree: (feature, limit, tree up to the limit, tree above it), or the share of label 1."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0) or len(y) < 2 * LEAF:
        return (share,)
    best = (len(y) * share * (1 - share) - 1e-9, None, None)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, good = x[order, f], np.cumsum(y[order])
        at = np.flatnonzero(v[1:] != v[:-1]) + 1
        at = at[(at >= LEAF) & (at <= len(y) - LEAF)]
        if not len(at):
            continue
        left, right = good[at - 1], good[-1] - good[at - 1]
        impurity = left * (1 - left / at) + right * (1 - right / (len(y) - at))
        i = int(impurity.argmin())
        if impurity[i] < best[0]:
            best = (impurity[i], f, (v[at[i]] + v[at[i] - 1]) / 2)
    if best[1] is None:
        return (share,)
    low = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


def predict(tree: tuple, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    out, low = np.empty(len(x)), x[:, tree[0]] <= tree[1]
    out[low], out[~low] = predict(tree[2], x[low]), predict(tree[3], x[~low])
    return out


@lru_cache
def trained() -> tuple:
    """The tree of the labelled table."""
    found = [blocks(p) for p in html_labels.pages()]
    return grow(np.concatenate([features(f) for f in found]), np.array([b[7] for f in found for b in f], float))


def main_text(html: str | None, tree: tuple | None = None) -> str:
    found = blocks(html) if html else []
    if not found:
        return ""
    keep = predict(tree or trained(), features(found)) >= 0.5
    return "\n\n".join(b[0] for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    own = pages.select("page_id", "url", "html")
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"
    tree = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                text = [main_text(h, tree) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(text, pa.string()),
                                                  pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return own.mapInArrow(run, schema)
