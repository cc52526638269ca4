"""Main text of web pages: flat text blocks, classified by a decision tree on word counts and link densities of neighbours.

A page is cut into tags and text by one pattern (linear in its length). Block elements begin and end blocks, inline ones
(and line breaks) don't; raw text, form controls and other content that is never read is left out. What lies in a menu,
header, footer, sidebar, notice, advert, form or list of reader comments goes first, told by its element or by a whole name in
class, id or role. Names count for nothing on html, body, main and the page's article, nor on what holds these or most of
the page's words, so that no wrapper empties a page.

Each block that is left has its number of words, the share of its characters inside links, the same of the block before and after,
whether it is a heading, the words of prose (blocks of PROSE_WORDS or more with few links) in its own container, before it
and after it, and whether it lies inside the page's article or main part, outside, or the page has none. A decision tree (Gini,
grown here on the labelled pages of LAYOUTS, with and without article elements) decides.

Defined results: null and empty pages, and pages without content, give an empty text; unclosed and stray tags are taken
as browsers would roughly take them; tags that never end are text; character references are decoded once; equal pages
give equal texts; repeated rows give a row each; an empty table gives no rows; extra columns, whatever their names, are
ignored. No block is dropped or cut for its length alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape
from itertools import accumulate, product

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_arrow, slices

#: Element names of the HTML standard.
RAW = "script style textarea select button option noscript template svg math iframe object canvas audio video head title".split()
BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = set("article aside body details dialog div dl fieldset figure footer form header li main menu nav ol search section table td ul".split())
HOLDERS = set("article body details div main section td".split())
LISTS = set("ul ol menu".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
ASIDE = set("aside dialog footer menu nav search".split())
FORMS = set("fieldset form".split())
#: Names in class, id or role that mark what is no part of an article; those of comments; words that may stand beside them in a name.
MARKS = set("ad ads advert advertisement advertisements advertising adverts banner breadcrumb breadcrumbs complementary consent contentinfo cookie cookies footer gdpr login masthead menu menus modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion recommended related search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split())
COMMENTS = set("comment comments disqus remark remarks replies reply respond".split())
BESIDE = set("area articles bar block bottom box button buttons center col column container content count form global group inner item items left link links list main message overlay page panel post posts primary reader right row secondary section site slot text thread top unit user wrap wrapper".split())
#: Names of a header, outside of articles.
HEADERS = set("header site-header main-header global-header top-header page-top".split())
PROSE_WORDS, PROSE_DENSITY = 10, 1 / 3
#: An element that holds this share of the page's words (or half of them and a first-level heading) is not judged by its name.
MOST_WORDS = 0.9
#: The least share of the page's prose that articles (or main parts) must hold to be taken for the page's text.
LEAST_INSIDE = 0.3
_ATTRIBUTE = r"""(?:[^<>"']++|"[^"]*+"|'[^']*+')*+"""
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{'|'.join(RAW)})(?=[\s/>]){_ATTRIBUTE}>(?:(?<=/>)|.*?(?:</(?P=raw)\s*+>|\Z))|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attributes>{_ATTRIBUTE})>|<[!?][^>]*+>",
    re.DOTALL | re.IGNORECASE,
)
_NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_HREF = re.compile(r"(?:^|\s)href\s*=", re.IGNORECASE)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
ARTICLE, MAIN, OUTSIDE = 2, 1, 0


@dataclass
class Block:
    text: str
    words: int
    link_density: float
    heading: bool
    region: int
    #: Number of the container that holds it.
    holder: int


@dataclass
class Element:
    """An element that is no part of an article, unless what it holds says otherwise; first and last: its blocks."""

    sure: bool
    comments: bool
    first: int
    last: int = -1


@lru_cache(maxsize=20_000)
def _name_kinds(attributes: str) -> tuple[bool, bool, bool]:
    """Whether some whole name in class, id or role is one of MARKS, of COMMENTS, of HEADERS, each with words of BESIDE at most."""
    marked = comments = header = False
    for values in _NAMED.findall(attributes):
        for name in "".join(values).split():
            name = _CAMEL.sub("-", name).lower()
            header |= name in HEADERS
            parts = {p for p in (x.strip("0123456789") for x in re.split(r"[-_:]+", name)) if p}
            if parts <= MARKS | COMMENTS | BESIDE:
                comments |= bool(parts & COMMENTS)
                marked |= bool(parts & MARKS)
    return marked, comments, header


class Page:
    """Blocks of a page in order, without those of menus and the like."""

    def __init__(self, page: str) -> None:
        self.found: list[Block] = []
        self.elements: list[Element] = []
        self.mains: list[int] = []  # block before which each article or main part begins
        self.titles: list[int] = []  # blocks that are first-level headings
        self._parts: list[str] = []
        self._linked, self._link_depth, self._heading, self._level = 0, 0, False, ""
        #: Open containers: name, region, holder, Element or None.
        self._stack: list[tuple[str, int, int, Element | None]] = []
        self._own: Element | None = None
        self._holders = 0
        at = 0
        for m in _TOKEN.finditer(page):
            if m.start() > at:
                self._add(page[at : m.start()])
            at = m.end()
            if m["name"] is not None:
                self._tag(m["name"].lower(), bool(m["end"]), m["attributes"])
        if at < len(page):
            self._add(page[at:])
        self._close()
        self._pop(0)

    def _add(self, text: str) -> None:
        self._parts.append(text)
        if self._link_depth:
            self._linked += len(unescape(text).strip())

    def _close(self) -> None:
        if self._parts:
            text = " ".join(unescape("".join(self._parts)).split())
            if text:
                _, region, holder, _ = self._stack[-1] if self._stack else ("", OUTSIDE, 0, None)
                if self._level == "h1":
                    self.titles.append(len(self.found))
                self.found.append(Block(text, text.count(" ") + 1, min(1.0, self._linked / len(text)), self._heading, region, holder))
            self._parts.clear()
        self._linked = 0
        if self._own:
            self._own.last = len(self.found)
            self._own = None

    def _pop(self, depth: int) -> None:
        for *_, element in self._stack[depth:]:
            if element:
                element.last = len(self.found)
        del self._stack[depth:]
        if self._link_depth > depth + 1:  # a link that its container leaves open
            self._link_depth = 0

    def _element(self, name: str, attributes: str, region: int) -> Element | None:
        sure = name in ASIDE or name == "header" and region == OUTSIDE
        marked, comments, header = _name_kinds(attributes) if attributes else (False, False, False)
        if name in ("html", "body", "main") or name == "article" and not (comments and self.mains):
            return None
        if not (sure or name in FORMS or marked or comments or header and region == OUTSIDE):
            return None
        self.elements.append(Element(sure, comments, len(self.found)))
        return self.elements[-1]

    def _tag(self, name: str, end: bool, attributes: str) -> None:
        if name in BLOCKS:
            self._close()
            self._heading, self._level = name in HEADINGS and not end, "" if end else name
            if name not in CONTAINERS:
                if not end and attributes:
                    self._own = self._element(name, attributes, self._stack[-1][1] if self._stack else OUTSIDE)
            elif end:
                for k in range(len(self._stack) - 1, -1, -1):
                    if self._stack[k][0] == name:
                        self._pop(k)
                        break
            elif not attributes.endswith("/"):
                if name == "li":
                    self._end_item()
                _, region, holder, _ = self._stack[-1] if self._stack else ("", OUTSIDE, 0, None)
                element = self._element(name, attributes, region)
                if name in ("article", "main") and element is None:
                    region = max(region, ARTICLE if name == "article" else MAIN)
                    self.mains.append(len(self.found))
                if name in HOLDERS:
                    self._holders += 1
                    holder = self._holders
                self._stack.append((name, region, holder, element))
        elif name == "a":
            self._link_depth = 0 if end or not _HREF.search(attributes) else len(self._stack) + 1
        elif name in ("br", "img", "input"):
            self._add(" ")

    def _end_item(self) -> None:
        """A new list item ends the one before it."""
        for k in range(len(self._stack) - 1, -1, -1):
            if self._stack[k][0] in LISTS:
                return
            if self._stack[k][0] == "li":
                self._pop(k)
                return

    def blocks(self) -> list[Block]:
        total = list(accumulate((b.words for b in self.found), initial=0))
        gone = [0] * (len(self.found) + 1)
        for e in self.elements:
            words = total[e.last] - total[e.first]
            held = words >= MOST_WORDS * total[-1] or 2 * words >= total[-1] and any(e.first <= t < e.last for t in self.titles)
            if not e.comments:
                held |= bool(self.mains) and all(e.first <= x < e.last for x in self.mains)
            if e.sure or not held:
                gone[e.first] += 1
                gone[e.last] -= 1
        return [b for b, n in zip(self.found, accumulate(gone), strict=False) if not n]


FEATURES = ("words", "link_density", "words_before", "density_before", "words_after", "density_after", "heading", "held_prose", "prose_before", "prose_after", "inside")
Row = tuple[float, ...]


def features(found: list[Block]) -> list[Row]:
    """FEATURES of each block of a page."""
    prose = [b.words if b.words >= PROSE_WORDS and b.link_density < PROSE_DENSITY else 0 for b in found]
    every, held = sum(prose), {}
    for b, n in zip(found, prose, strict=True):
        held[b.holder] = held.get(b.holder, 0) + n
    level = next((r for r in (ARTICLE, MAIN) if any(b.region >= r for b in found) and sum(n for b, n in zip(found, prose, strict=True) if b.region >= r) >= LEAST_INSIDE * every), OUTSIDE)
    edge = Block("", 0, 0.0, False, OUTSIDE, 0)
    out, before = [], 0
    for last, b, following, n in zip([edge, *found], found, [*found[1:], edge], prose, strict=False):
        inside = 0 if level == OUTSIDE else 1 if b.region >= level else -1
        out.append((b.words, b.link_density, last.words, last.link_density, following.words, following.link_density, float(b.heading), held[b.holder], before, every - before - n, inside))
        before += n
    return out


#: Fixed values, the labelled table: a page a line, its blocks in order: + for main text, - for the rest, h for a heading, words,
#: and after a colon the share of links. | begins a container, A one inside an article element.
LAYOUTS = """
-1:1 -1:1 -2:1 -1:1 | -8 |A +h10 +70 +3 +55 +1 +90 +6 +80 | -12:.1
-1:1 -2:1 | -16 |A +h8 +9 +12 +1 | -6
-2:1 -1:1 |A +h6 +2 +2 +3 | -9 -4:.5
-1:1 |A +h9 +4 +120:.05 +40:.2 +8:1 +50 +15:.4 +60 -1:1 -1:1 -2:1 -1:1 | -h3 -30 -45 | -14
-3 -1:1 -1:1 |A +h12 +5:.2 +35 +2 +h3 +4 +6 +3 +42 +h2 +25:.1 +33 |A +h7 +28 +1 | -h2 -9:1 -11:1 -8:1 | -20:.1
|A +h5 +1 | -7
|A +200 +3
-1:1 -1:1 -1:1 -60 |A +h9 +75 +75 -2:1 -3:1 -1:1 | -90 -75 -3:1 | -10
-2:1 |A +6 +9 +30 +12:.9 +45 | -h4 -12:1 -13:1 -15:1
-25 |A +h8 +11:.1 +64 -1:1 -1:1 -1:1 -1:1 -2:1 +38 | -h3 -5:1 -40
-1:1 -2:1 -1:1 | +h9 +58 +3 +58 | -2:1 -1:1 -3:1 | -7
-1:1 -1:1 | +h6 +4 +60 +40 +45 +h3 +30 +5 +4 +6 +55 | -h2 -8:1 -9:1 -7:1 | -9:.3
-2:1 -1:1 -1:1 +h8 +45 +52 +2 +60 +38 -1:1 -2:1 -1:1 -8
-1:1 -1:1 -1:1 | +h5 +35 +28 | -5
-1:1 -2:1 | +22 +18 | -1:1 -2:1 -6
-1:1 -1:1 | -14 | +h7 +80 +64 +9 +70 | -11:.2
+120
+25
+12
+14 +9 +16
+h3 +13 +11 | -2:1
-1:1 -2:1 | +h2 +15 +4 | -4
-9 |A +70 +3 | -9
-1:1 |A +h9 +60 +45 |A -1:1 -2:1 -1:1 -1:1 | -5
|A +h6 +50 +3 +40 |A -1:1 -1:1 |A +33 |A +4 +2 |A +28
|A -2:1 -1:1 -3:1 |A +h8 +60 +55 +2 |A +5 +3 +1
-7 -2:1 |A +45 +h4 +30 | -6 | -40
-12:.1 |A +h10 +38 +60 +2 | -3 -1:1
-9 | +h9 +70 +3 +42 | -9
-6:.3 | +h14 +38 +60 +2 | -3 -8:1 -9:1 | -4
-4 -2:1 |A +h13 +25 | -h4 -16:1 -11:1
-5 |A +h3 +60 +35 | -h2 -8:1 -14:1 -10:1 | -7:.4
+45 +2
-3
-2 -3:1
-1:1 -1:1 -2:1
-3:1 -5 -2:1 -4:1 -3:.5
-2:1 -3:1 | +h6 +40:.2 +55:.3 +30:.25 +8:1 +45 +2 | -12:1 -14:1 -11:1
-6:.8 +h8 +60 +70 +5 +66 | -4:1 -3:1
-1:1 -1:1 | +h8 -3:1 -1:1 -1:1 +60 +64 +1 | -8:.4
-1:1 | +h4 +3 +5 +4 +2 +60 +40 +3 +3 +4 +38 +1 | -h2 -1:1 -2:1 -1:1 | -8
-4 -1:1 -2:1 -1:1 | +h7 +48 | +h3 +56 +2 +5 | +h2 +33 +41 | -2:1 -3:1 -2:1 -6
-2:1 -1:1 -3:1 | -7 | +h9 +6 | +90 +85 +4 +72 | -10 -1:1 -1:1
| -1:1 -1:1 -1:1 -1:1 | -12 -3:1 | +58 +58 +3 +2 +58 | -9:.9 -10:.9 -8:1 | -13:.1
-8 | -1:1 -1:1 | +30 +6 +3 +28 | -11
-1:1 -1:1 | +65 +4 +5 +6 +72 | -3:1 -9
-1:1 | +h5 +18 +11 +14 +2 +21 +1 | -4:1 -2:1 -9
"""


#: Each layout stands there with its longer blocks as they are, shorter and longer.
SCALES, SCALED_FROM = (1.0, 0.75, 1.6), 20


def labelled_rows() -> list[Row]:
    """FEATURES and label of every block in LAYOUTS, at every scale."""
    out: list[Row] = []
    for line, scale in product(LAYOUTS.strip().splitlines(), SCALES):
        found, labels = [], []
        for holder, container in enumerate(line.split("|")):
            region = ARTICLE if container.startswith("A") else OUTSIDE
            for token in container.removeprefix("A").split():
                words, _, density = token[1:].removeprefix("h").partition(":")
                n = int(words) if int(words) < SCALED_FROM else int(int(words) * scale)
                found.append(Block("", n, float(density or 0), token[1] == "h", region, holder))
                labels.append(float(token[0] == "+"))
        out += [(*row, label) for row, label in zip(features(found), labels, strict=True)]
    return out


@dataclass
class Leaf:
    label: int


@dataclass
class Split:
    feature: int
    limit: float
    low: Leaf | Split
    high: Leaf | Split


def grown(rows: list[Row], depth: int = 8) -> Leaf | Split:
    """A tree of splits `feature <= limit` with the least Gini impurity; the last entry of a row is its label. Equal gains: the first feature, the lowest limit."""
    ones = sum(r[-1] for r in rows)
    if not depth or ones in (0, len(rows)):
        return Leaf(int(2 * ones >= len(rows)))
    gini = lambda n, k: 2 * k * (n - k) / n
    best = (gini(len(rows), ones) - 1e-9, -1, 0.0)
    for f in range(len(rows[0]) - 1):
        ordered, low = sorted(rows, key=lambda r: r[f]), 0.0
        for n, (a, b) in enumerate(zip(ordered, ordered[1:], strict=False), 1):
            low += a[-1]
            if a[f] < b[f]:
                best = min(best, (gini(n, low) + gini(len(rows) - n, ones - low), f, (a[f] + b[f]) / 2))
    _, f, limit = best
    if f < 0:
        return Leaf(int(2 * ones >= len(rows)))
    return Split(f, limit, grown([r for r in rows if r[f] <= limit], depth - 1), grown([r for r in rows if r[f] > limit], depth - 1))


@lru_cache(maxsize=1)
def tree() -> Leaf | Split:
    return grown(labelled_rows())


def is_content(node: Leaf | Split, row: Row) -> int:
    while isinstance(node, Split):
        node = node.low if row[node.feature] <= node.limit else node.high
    return node.label


def main_text(page: str | None) -> str:
    found, node = Page(page or "").blocks(), tree()
    return "\n".join(b.text for b, row in zip(found, features(found), strict=True) if is_content(node, row))


def op5(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").transform(in_arrow, run, "page_id long, url string, text string, n_chars long")
