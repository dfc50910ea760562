"""Operator 11: main text of a page by the distribution of its line blocks.

Markup is stripped in one forward scan; every block element gives a line. What markup itself names as no part
of the article (menus, headers, footers, sidebars, adverts, notices, forms, comments, scripts, hidden parts)
leaves blank lines. The length of a line counts its characters outside links. The lengths are summed over
sliding windows of lines; text surges where a window holds much, and dives where windows are next to empty
or blank lines follow. The lines between a surge and its dive are kept. Where the page marks its article
(article or main), the lines outside count as blank and any text in a window is a surge.

A null page is empty. Tags without an end, unclosed comments and unclosed quotes end at the page's end or at
the next sign that can end them; no input takes more than one scan. Repeated rows and null ids give a row
each; other columns are left aside, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxlake.llm.markup import CLOSE, OPEN, TEXT, Scan
from taxlake.llm.shared import only

#: Lines of a window, characters that make a surge, and the share of it below which text has dived.
WINDOW, SURGE, DIVE = 3, 86, 0.25
#: Least share of a page's text that an article element must hold to be believed.
BELIEVED = 0.1

#: Elements that are no part of an article.
OUTSIDE = frozenset(
    "head nav footer aside form header menu dialog select button svg math object canvas audio video map datalist fieldset".split()
)
#: Of these, the ones that may wrap a whole page, or lack an end: an article inside them is one all the same.
WRAPPERS = frozenset("nav header form".split())
#: Elements that may stand in a head.
HEAD = frozenset("meta link base title script style noscript template".split())
#: Elements that run inside a line. All others start and end one.
INLINE = frozenset(
    "a abbr acronym area b base bdi bdo big br cite code col data del dfn em embed font i img input ins kbd label link map"
    " mark meta param q rp rt ruby s samp small source span strike strong sub sup td th time track tt u var wbr".split()
)
#: Elements that end the one of the same name before them.
REPEATED = frozenset("li dd dt tr option p".split())
#: Blocks of running text: they are no container of lines.
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt tr blockquote pre figcaption address".split())
#: Words of class, id or role that name a part outside the article.
NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion"
    " sidebar aside nav navbar navigation menu submenu breadcrumb breadcrumbs masthead topbar header footer bottombar"
    " cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription"
    " signup login comment comments commentlist disqus respond reply replies discussion share sharing social related recommended"
    " recommendations teaser teasers pagination pager search toolbar copyright widget"
    " contentinfo complementary alertdialog dialog".split()
)
#: Those of them that hold even against an article element.
NOT_ARTICLE = frozenset(
    "ad ads advert advertisement promo sponsored sponsor comment comments commentlist disqus respond reply replies discussion"
    " related recommended recommendations teaser teasers sidebar aside complementary".split()
)
#: Words that turn such a name round, as in "with-sidebar".
TURNED = frozenset("with has no without".split())
#: Pairs of words that name an article where no element does.
BODIES = (("article", "body"), ("article", "content"), ("article", "text"), ("post", "content"), ("post", "body"), ("entry", "content"), ("story", "body"))

_NAMES = re.compile(r"""(?i)(?:^|[\s"'/])(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_ROLE_MAIN = re.compile(r"""(?i)(?:^|[\s"'/])role\s*=\s*["']?main\b""")
_HIDDEN = re.compile(
    r"""(?i)(?:^|\s)(?:hidden(?=[\s/=]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*(?:display\s*:\s*none|visibility\s*:\s*hidden))"""
)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_HOLDS_ARTICLE = re.compile(r"<(?:h1|article|main)[\s>]", re.I)
#: How a line lies in the page's own article: bits.
MAIN, ARTICLE, BODY = 1, 2, 4


def _named(attributes: str) -> frozenset[str]:
    """Lower-cased words of class, id, role and itemprop, without names that are turned round."""
    found: set[str] = set()
    for values in _NAMES.findall(attributes):
        for name in "".join(values).split():
            words = {w.lower() for w in _WORD.findall(name)}
            if not words & TURNED:
                found |= words
    return frozenset(found)


@dataclass
class _Element:
    name: str
    outside: bool  # no part of the article, nor is anything in it
    firm: bool  # so even around an article element
    states: int  # MAIN, ARTICLE, BODY or 0
    container: int  # the container around it


@dataclass
class Line:
    """A line of the page; a blank one stands for a part outside the article."""

    text: str = ""
    length: int = 0  # characters outside links and white space
    states: int = 0
    container: int = -1
    title: bool = False

    @property
    def blank(self) -> bool:
        return not self.text


class _Scan:
    """The lines of a page, from one scan over its markup that keeps the open elements."""

    def __init__(self, page: str):
        self.markup, self.lines = Scan(page), []
        self.open: list[_Element] = []
        self.counts: dict[str, int] = {}
        self.seeks_article = True
        self.outside = self.firm = self.container = self.containers = 0
        self.within = {MAIN: 0, ARTICLE: 0, BODY: 0}  # open elements that state the article
        self.link_depth: int | None = None
        self.title = False
        self.parts: list[str] = []
        self.plain: list[str] = []
        self._run()
        self._end_line()

    @property
    def states(self) -> int:
        return sum(bit for bit, n in self.within.items() if n)

    # lines

    def _text(self, raw: str) -> None:
        if raw and not self.outside:
            self.parts.append(raw)
            if self.link_depth is None:
                self.plain.append(raw)

    def _space(self) -> None:
        if self.parts:
            self.parts.append(" ")

    def _end_line(self) -> None:
        if self.parts:
            text = " ".join(entities.unescape("".join(self.parts)).split())
            if text:
                length = sum(map(len, entities.unescape("".join(self.plain)).split()))
                self.lines.append(Line(text, length, self.states, self.container, self.title))
            self.parts, self.plain = [], []

    def _blank(self) -> None:
        self._end_line()
        if self.lines and not self.lines[-1].blank:
            self.lines.append(Line())

    # elements

    def _close(self, upto: int) -> None:
        while len(self.open) > upto:
            e = self.open.pop()
            self._end_line()
            self.counts[e.name] -= 1
            self.container = e.container
            if e.states:
                self.within[e.states] -= 1
            if e.outside:
                self.outside -= 1
                self.firm -= e.firm
                if not self.outside:
                    self._blank()
            if self.link_depth is not None and len(self.open) < self.link_depth:
                self.link_depth = None

    def _last(self, name: str) -> int:
        at = len(self.open) - 1
        while self.open[at].name != name:
            at -= 1
        return at

    def _ended(self, name: str) -> None:
        if name == "a":
            self.link_depth = None
        elif name in ("br", "td", "th"):
            self._space()
        if self.counts.get(name):
            self._close(self._last(name))
        elif name not in INLINE:
            self._end_line()
        if name[0] == "h":
            self.title = False

    def _opened(self, name: str, attributes: str) -> None:
        if self.open and self.open[-1].name == "head" and name not in HEAD or name == "body":
            if self.counts.get("head"):
                self._close(self._last("head"))
        if name == "a":
            self.link_depth = len(self.open)
        elif name in ("br", "td", "th", "img"):
            self._space()
        block = name not in INLINE
        if block:
            self._end_line()
            if self.open and (self.open[-1].name == "p" or self.open[-1].name == name and name in REPEATED):
                self._close(len(self.open) - 1)
            self.title = name == "h1"
        if name == "hr":
            return
        named = _named(attributes) if "=" in attributes else frozenset()
        outside, firm = self._is_outside(name, attributes, named, block)
        if not block and not outside:
            return
        states = 0
        if not outside:
            if name == "main" or "main" in named and _ROLE_MAIN.search(attributes):
                states = MAIN
            elif name == "article" or "article" in named and "role" in attributes and not named & NOT_ARTICLE:
                states = ARTICLE
            elif any(a in named and b in named for a, b in BODIES):
                states = BODY
        if states in (MAIN, ARTICLE) and self.outside and not self.firm:
            at = len(self.open)
            while self.outside:
                at -= 1
                self.outside -= self.open[at].outside
                self.open[at].outside = False
        if outside:
            if not self.outside:
                self._blank()
            self.outside += 1
            self.firm += firm
        self.open.append(_Element(name, outside, firm, states, self.container))
        self.counts[name] = self.counts.get(name, 0) + 1
        if states:
            self.within[states] += 1
        if block and name not in TEXT_BLOCKS:
            self.containers += 1
            self.container = self.containers

    def _is_outside(self, name: str, attributes: str, named: frozenset[str], block: bool) -> tuple[bool, bool]:
        """(outside the article, even around an article element)."""
        if name in ("html", "body"):
            return False, False
        if attributes and _HIDDEN.search(attributes):
            return True, True
        if name == "main":
            return False, False
        if name == "article":
            return bool(named & NOT_ARTICLE), True
        if name in OUTSIDE:
            if name == "header" and self.states:
                return False, False  # the head of the article, with its title
            if name == "form" and self._holds_article():
                return False, False
            return True, name not in WRAPPERS
        if named & NAMED and (block or name == "span"):
            own = self.states and not named & NAMED - {"header", "search", "widget"}
            return not own, bool(named & NOT_ARTICLE)
        return False, False

    def _holds_article(self) -> bool:
        """Whether a heading or an article follows before the end of the form; sought in vain to the page's end only once."""
        at, end = self.markup.at, self.markup.find("</form", self.markup.at)
        if not self.seeks_article:
            return False
        found = _HOLDS_ARTICLE.search(self.markup.page, at, len(self.markup.page) if end < 0 else end)
        self.seeks_article = found is not None or end >= 0
        return found is not None

    def _run(self) -> None:
        for kind, name, rest in self.markup:
            if kind == TEXT:
                self._text(rest)
            elif kind == OPEN:
                self._opened(name, rest)
            elif kind == CLOSE:
                self._ended(name)


def lines_of(page: str) -> list[Line]:
    """The lines of a page."""
    return _Scan(page).lines


def _stated(lines: list[Line], length: np.ndarray) -> np.ndarray | None:
    """Which lines the page itself marks as its article, if what it marks holds a fair share of its text."""
    states = np.array([line.states for line in lines])
    main, article = (states & MAIN) > 0, (states & ARTICLE) > 0
    title = np.array([line.title for line in lines]) & main
    for region, least in ((article | title, max(length.sum() * BELIEVED, length[main].sum() * 0.5)), (main, length.sum() * BELIEVED)):
        if length[region].sum() >= max(least, 1) and (region is main or article.any()):
            return region
    body = (states & BODY) > 0
    return body if length[body].sum() >= max(length.sum() * BELIEVED, 1) else None


def kept_lines(lines: list[Line]) -> list[str]:
    """The lines between surges and dives."""
    if not lines:
        return []
    length = np.array([line.length for line in lines], dtype=np.int64)
    blank = np.array([line.blank for line in lines])
    stated = _stated(lines, length)
    if stated is not None:
        blank |= ~stated
        length[blank] = 0
    edges = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    runs = list(zip(edges[::2], edges[1::2]))  # stretches without a blank line
    sums = [_windows(length[a:b]) for a, b in runs]
    highest = max((int(s.max()) for s in sums), default=0)
    if not highest:
        return []
    surge = 1 if stated is not None else min(SURGE, (highest + 1) // 2)
    dive = max(1, int(surge * DIVE))
    # lines of the container of the fullest line are of the same text: a small surge is enough there
    home = lines[int(np.argmax(length))].container
    keep: list[int] = []
    for (a, b), windows in zip(runs, sums):
        own = any(line.container == home for line in lines[a:b])
        up = np.zeros(b - a + 1, dtype=np.int64)  # a line is up while one of the windows that hold it is
        at = np.flatnonzero(windows >= (1 if own else dive))
        np.add.at(up, at, 1)
        np.add.at(up, np.minimum(at + WINDOW, b - a), -1)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], np.cumsum(up[:-1]) > 0, [False]]).astype(np.int8)))
        for first, last in zip(edge[::2], edge[1::2]):
            if windows[first:last].max() < surge and all(line.container != home for line in lines[a + first : a + last]):
                continue
            texts = range(a + first, a + last)
            # at either end, what only the windows of its neighbours hold up: links, and short lines of other containers
            firm = [
                i for i in texts
                if length[i] and (stated is not None or lines[i].container == home or lines[i].title or length[i] >= surge / 2)
            ]
            if firm:
                keep.extend(range(firm[0], firm[-1] + 1))
    return [lines[i].text for i in keep]


def _windows(length: np.ndarray) -> np.ndarray:
    """Sum of each window of lines that starts in a stretch; the last ones are shorter."""
    total = np.concatenate([[0], np.cumsum(length)])
    ends = np.minimum(np.arange(len(length)) + WINDOW, len(length))
    return total[ends] - total[: len(length)]


def main_text(page: str | None) -> str:
    """The main text of a page, blocks joined by two line ends."""
    return "\n\n".join(kept_lines(lines_of(page))) if page else ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            rows = batch.slice(start, 256)
            text = [main_text(page.as_py()) for page in rows.column(2)]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html)."""
    rows = only(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
