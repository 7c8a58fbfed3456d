"""Main-text extraction by tag-path ratios.

A page becomes a tree of elements and a list of blocks of text, each with the tag path from the root to it. Text
length and punctuation are summed by path and divided by the path's blocks; both ratios are smoothed
along the page and fused, and the paths whose mean passes a threshold hold content. The element with most
of that content is the article; in it, blocks of other paths stay only between content and only if they are not links.
Elements that are boilerplate by their kind never take part, nor do those that are so by name, unless they hold an
article or most of the page's text. Every step is linear in the page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import ship, steps

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"<]*\"|'[^'<]*'|[^>\"']++)*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</?\Z",
    re.S,
)
# Fixed values of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big button canvas cite code data del dfn em font i img ins kbd label map mark object q rp rt ruby s samp select small span strike strong sub sup svg time tt u var video audio wbr nobr".split()
)
#: Elements whose text is not markup: everything up to the end tag belongs to them.
_RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes".split())
#: Elements that are never part of an article.
_PRUNED = frozenset("head nav header footer aside form menu dialog button select option svg canvas object audio video map script style noscript template iframe textarea title xmp noembed noframes".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_KEEPS_P = frozenset("table td th li dd dt body html".split())
#: Elements of those kinds that some pages put around everything.
_AROUND = frozenset(("form", "dialog", "object"))
_LIST_ENDS = ("ul", "ol", "dl", "table", "article", "main", "section")
#: Elements whose class is part of a path: what they hold says more than their tag.
_CONTAINERS = frozenset("div section table tbody tr td ul ol dl".split())
#: Elements that no name prunes: the page, its article and headings.
_WHOLE = frozenset(("html", "body", "main", "article"))
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Words of class, id and role values that name boilerplate.
_NAMED = re.compile(
    r"(?:ads?|adverts?|advertisements?|adsense|banners?|sponsor(?:ed|s)?|promos?|promotions?|cookies?|consent|gdpr|notices?|alerts?|nav|navbar|navigation|menus?"
    r"|sidebars?|breadcrumbs?|footers?|headers?|masthead|comments?|disqus|replies|respond|shares?|sharing|social|related|recommended|popups?|modals?|newsletters?|subscribe|subscription"
    r"|widgets?|toolbar|pagination|pager|skip|contentinfo|complementary|search|login|signup)"
)
#: Words that stand beside them in names of the same kind: a name with any other word says something else.
_BESIDE = re.compile(
    r"(?:site|global|main|primary|secondary|top|bottom|left|right|upper|lower|mobile|desktop|sticky|box|block|area|list|section|container|wrap|wrapper|inner|outer|row|col|bar|slot|unit|items?"
    r"|links?|posts?|articles|stories|content|to|form|field|input|buttons?|btn|icons?|group|panel|overlay|thread|feed|text|label|messages?|\d+)"
)
_ATTRIBUTE = re.compile(r"(?i)(?:^|\s)(class|id|role|aria-hidden|style|hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?(?=[\s/]|$)")
_PUNCTUATION = re.compile("[.,;:!?。，、；：！？…]")
_MAIN = frozenset(("article", "main"))


def _named(value: str) -> bool:
    """Whether a name of the value is made of words for boilerplate, and words that go with them, alone."""
    for name in value.lower().split():
        words = [w for w in re.split("[-_]+", name) if w]
        if any(map(_NAMED.fullmatch, words)) and all(_NAMED.fullmatch(w) or _BESIDE.fullmatch(w) for w in words):
            return True
    return False


def _is_named(attributes: str) -> bool:
    return any(name.lower() in ("class", "id", "role") and _named(value.strip("\"'")) for name, value in _ATTRIBUTE.findall(attributes))


def _is_hidden(attributes: str) -> bool:
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"(?i)display\s*:\s*none", value):
            return True
    return False


class _Tree:
    """The elements of a page in page order, and its pieces of text by block.

    Of each element: tag, parent, tag path (a number), whether an end tag closed it, whether its names say boilerplate or it is
    hidden. Element 0 is the page. Of each piece: text, the element it is in, whether it is link text; blocks are runs of pieces.
    """

    def __init__(self, page: str):
        self.tags, self.parents, self.paths = [""], [0], [0]
        self.closed, self.named, self.hidden = [True], [False], [False]
        self.pieces: list[tuple[str, int, bool]] = []
        self.blocks: list[tuple[int, int, int]] = []  # first piece, end, block element
        self.numbers: dict[tuple[int, str], int] = {}
        self.open = [0]
        self.block_at = [0]  # places of block elements in ``open``
        self.places: dict[str, list[int]] = {}  # places in ``open`` by tag
        self.link = -1  # the open element that makes text link text
        self.first = 0
        self._read(page)

    def _flush(self) -> None:
        if len(self.pieces) > self.first:
            self.blocks.append((self.first, len(self.pieces), self.open[self.block_at[-1]]))
            self.first = len(self.pieces)

    def _text(self, raw: str) -> None:
        if raw:
            self.pieces.append((html.unescape(raw) if "&" in raw else raw, self.open[-1], self.link >= 0))

    def _start(self, tag: str, attributes: str) -> None:
        if tag not in _INLINE:
            self._flush()
            if tag in _CLOSES:
                self._close(self._last(_CLOSES[tag], _LIST_ENDS))
            self._close(self._last(("p",), _KEEPS_P))
            self.block_at.append(len(self.open))
        named = attributes and (tag not in _WHOLE and tag not in _HEADINGS) and _is_named(attributes)
        label = tag
        if attributes and tag in _CONTAINERS:
            found = dict((n.lower(), v.strip("\"'")) for n, v in _ATTRIBUTE.findall(attributes))
            label = f"{tag}.{' '.join(sorted(found.get('class', '').split()))}"
        parent = self.open[-1]
        path = self.paths[parent]
        if tag not in _INLINE:
            path = self.numbers.setdefault((path, label), len(self.numbers) + 1)
        number = len(self.tags)
        self.tags.append(tag)
        self.parents.append(parent)
        self.paths.append(path)
        self.closed.append(False)
        self.named.append(bool(named))
        self.hidden.append(bool(attributes) and tag not in ("html", "body") and _is_hidden(attributes))
        if tag == "a":
            self.link = number if "href" in attributes.lower() else -1
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append(number)

    def _close(self, to: int) -> None:
        """Closes the open elements from place ``to`` on; none if it is negative."""
        if to < 0:
            return
        if self.block_at[-1] >= to:
            self._flush()
        while len(self.open) > to:
            gone = self.open.pop()
            self.places[self.tags[gone]].pop()
            if self.block_at[-1] == len(self.open):
                self.block_at.pop()
            if gone == self.link:
                self.link = -1

    def _last(self, tags: frozenset | set | tuple, stop: frozenset | tuple = ()) -> int:
        """The place of the innermost open element of some tags; -1 if one of ``stop`` is further in or there is none."""

        def innermost(names: frozenset | set | tuple) -> int:
            return max((self.places[t][-1] for t in names if self.places.get(t)), default=-1)

        at = innermost(tags)
        return at if at > innermost([t for t in stop if t not in tags]) else -1

    def _end(self, tag: str) -> None:
        at = self._last((tag,))
        if at < 0:
            return
        if tag in _INLINE and self.block_at[-1] > at:  # blocks inside go on; only a link ends
            self.link = -1 if tag == "a" else self.link
            return
        self.closed[self.open[at]] = True
        self._close(at)

    def _read(self, page: str) -> None:
        at = 0
        while found := _TOKEN.search(page, at):
            self._text(page[at : found.start()])
            at = found.end()
            closing, tag, rest = found.group(1), found.group(2), found.group(3)
            if tag is None:
                closing, tag, rest = found.group(4), found.group(5), found.group(6)
                if tag is None:
                    if found.group().startswith("<![CDATA["):
                        self._text(html.escape(found.group()[9:].removesuffix("]]>"), quote=False))
                    continue
                if not found.group().endswith(">"):
                    continue  # the page ends inside a tag
            tag = tag.lower()
            if closing:
                self._end(tag)
            elif tag == "br":
                self._text(" ")
            elif tag == "hr":
                self._flush()
            elif tag in _RAW:
                end = _raw_end(tag).search(page, at)
                stop = page.find(">", end.end()) if end else -1
                at = len(page) if stop < 0 else stop + 1
            elif tag not in _VOID:
                self._start(tag, rest)
        self._text(page[at:])
        self._flush()

    def pruned(self) -> list[bool]:
        """Whether each element is boilerplate, or in some that is."""
        n = len(self.tags)
        mass = [0] * n  # text outside links
        for text, e, linked in self.pieces:
            if not linked:
                mass[e] += sum(map(len, text.split()))
        for e in range(n - 1, 0, -1):
            mass[self.parents[e]] += mass[e]
        # What lies around the largest article.
        above_main, gone = set(), [False] * n
        largest = max((e for e in range(1, n) if self.tags[e] in _MAIN), key=lambda e: (mass[e], -e), default=0)
        while largest:
            largest = self.parents[largest]
            above_main.add(largest)
        for e in range(1, n):
            above, tag = self.parents[e], self.tags[e]
            most, around = 2 * mass[e] > mass[0], e in above_main
            kind = tag in _PRUNED and not (most and tag in _AROUND) and not (not self.closed[e] and (around or most))
            gone[e] = gone[above] or kind or self.hidden[e] and not around or self.named[e] and not (around or most)
        return gone


def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"(?i)</{re.escape(tag)}(?=[\s/>])")


def _smooth(values: np.ndarray) -> np.ndarray:
    """Each value averaged with its neighbours, 1 : 2 : 1; the ends stand in for what lies beyond them."""
    return (np.concatenate((values[:1], values[:-1])) + 2 * values + np.concatenate((values[1:], values[-1:]))) / 4


def main_text(page: str, strength: float = 0.5) -> str:
    """The article's blocks in page order, one to a line; empty if there are none.

    ``strength`` times the standard deviation of the blocks' fused ratios is the threshold of a path's mean, as far as the largest passes it.
    """
    tree = _Tree(page)
    gone = tree.pruned()
    texts, owners, links = [], [], []
    for first, end, owner in tree.blocks:
        kept = [p for p in tree.pieces[first:end] if not gone[p[1]]]
        text = " ".join("".join(p[0] for p in kept).split())
        if text:
            texts.append(text)
            owners.append(owner)
            links.append(min(len(text), sum(len(p[0].strip()) for p in kept if p[2])))
    if not texts:
        return ""
    _, path = np.unique([tree.paths[e] for e in owners], return_inverse=True)
    nodes = np.bincount(path)
    length = np.array([len(t) for t in texts], float)
    marks = np.array([len(_PUNCTUATION.findall(t)) for t in texts], float)
    total = np.bincount(path, length)
    link_share = np.bincount(path, np.array(links, float)) / total
    # The ratios of each block's path, smoothed along the page, fused by their geometric mean.
    fused = np.sqrt(_smooth((total / nodes)[path]) * (1 + _smooth((np.bincount(path, marks) / nodes)[path]))) * (1 - link_share[path])
    mean = np.bincount(path, fused) / nodes
    passed = mean >= min(strength * fused.std(), mean.max())
    content = (passed & (mean > 0))[path]
    if not content.any():
        return ""
    inside = _article(tree, owners, content, length * (1 - link_share[path]))
    at = np.flatnonzero(content & inside)
    between = np.arange(len(texts))
    between = (between > at[0]) & (between < at[-1])
    kept = inside & (content | between & (link_share[path] < 0.5))
    return "\n".join(texts[i] for i in np.flatnonzero(kept).tolist())


def _article(tree: _Tree, owners: list[int], content: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Whether each block is in the article: the element of that kind with most content if it has half of all, else the deepest element with most of it."""
    n = len(tree.tags)
    mass, last = [0.0] * n, list(range(n))
    for i in np.flatnonzero(content).tolist():
        mass[owners[i]] += float(weight[i])
    for e in range(n - 1, 0, -1):
        above = tree.parents[e]
        mass[above] += mass[e]
        last[above] = max(last[above], last[e])
    whole = mass[0]
    article = max((e for e in range(1, n) if tree.tags[e] in _MAIN), key=lambda e: (mass[e], -e), default=0)
    if not article or 2 * mass[article] < whole:
        article = max(e for e in range(n) if mass[e] >= 0.8 * whole)
        # One paragraph can outweigh the rest: then the element around it is what was looked for.
        if article and all(e == article for e in owners if article <= e <= last[article]):
            article = tree.parents[article]
            while article and tree.tags[article] in _INLINE:
                article = tree.parents[article]
    return np.array([article <= e <= last[article] for e in owners])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) of every row; ``text`` is the whole main text, empty where there is none.

    Null html counts as empty; a null url stays null. Character references are decoded, white space inside a block
    becomes one space and blocks are joined by a line feed; nothing else is dropped or capped. Repeated
    rows are extracted alike. No shuffle; a worker holds one slice of pages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "html"):
            texts = [main_text(x) for x in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array(texts, pa.string())], ["id", "url", "text"])

    ship(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return rows.mapInArrow(run, "id long, url string, text string").withColumnsRenamed({"id": id_col, "url": url_col})
