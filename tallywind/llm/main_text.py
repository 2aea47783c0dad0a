"""Main text of web pages: parser events, text-to-tag ratios, smoothing, threshold clustering.

The standard library's streaming parser turns a page into lines: stretches of text between block-level tags, each with
its number of characters and of tags. The ratio of both is high in running text and low in menus. Ratios are smoothed over
neighbouring lines with a Gaussian and split into two clusters; the upper one is the core of the page, and the zones that markup names
as something else (menus, adverts, comments, ...) have ratio 0. The core tells which region is the content: the articles, if they hold
half of it or more; else the smallest element around the core that leaves out nothing that reads as text. In the region everything
stays, short lines too, but for marked zones and, outside articles, for lists of links.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements without content, and elements inside a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements, roles and words of classes or ids that mark what isn't the article.
OTHER_TAGS = frozenset(
    "head title script style noscript template nav header footer aside form button select textarea menu dialog svg iframe object canvas".split()
)
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
OTHER_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices
    popup modal overlay newsletter subscribe subscription signup sidebar sidebars aside menu nav navbar navigation breadcrumb breadcrumbs header
    masthead footer alert alerts discussion trackbacks comment comments commentlist disqus replies respond related recommended share sharing social toolbar pagination pager login
    search widget widgets""".split()
)
#: Before one of the words, these describe the layout, as "has-sidebar" does.
LAYOUT_WORDS = frozenset("has no with without".split())
#: On a heading, these name its place.
HEADING_WORDS = frozenset("header masthead banner".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Marks of a zone: by words of classes or ids, which an article inside may overrule, or by element, role or attribute.
BY_WORDS, BY_MARKUP = 1, 2
CONTAINERS = frozenset("body div section td center ul ol dl".split())
WHOLE = frozenset("article main".split())
#: Own classes or ids with these make an article something else.
ARTICLE_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored promo comment comments reply replies respond related recommended teaser
    newsletter widget""".split()
)
#: Text in these elements reads as text, however short it is; other text does if it ends like a sentence.
READ = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt figcaption".split())
SENTENCE_END = (".", "!", "?", "\u2026", "\u3002", ":", '"', "\u201d")
#: An element that holds so much of the core, in hundredths, may be the region.
BULK = 90


class Line(NamedTuple):
    """`links`: characters inside links; `mark`: 0 for none; `reads`: in an element of running text."""

    text: str
    tags: int
    container: int
    mark: int
    links: int
    heading: bool
    reads: bool


class Open(NamedTuple):
    """An open element: what holds for text inside it."""

    tag: str = ""
    container: int = 0
    mark: int = 0
    inside: bool = False  # an article
    link: bool = False
    heading: bool = False
    reads: bool = False


class Lines(HTMLParser):
    """Collects a page's lines in order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.text: list[str] = []
        self.tags = self.links = 0
        self.heading = self.reads = False
        self.parents = [0]  # of containers, which come after theirs; 0 is the page
        self.articles, self.overruled = set(), set()
        self.open: list[Open] = []
        # Places in `open` by tag, of articles, and of what a new paragraph or item doesn't close.
        self.places: dict[str, list[int]] = {}
        self.wholes: list[int] = []
        self.blocks: list[int] = []

    def _state(self) -> Open:
        return self.open[-1] if self.open else Open()

    def _end_line(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                now = self._state()
                self.lines.append(Line(text, self.tags, now.container, now.mark, self.links, self.heading, self.reads))
                self.tags = 0
            self.text, self.links, self.heading, self.reads = [], 0, False, False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.text.append(" ")
            self.tags += 1
            return
        if tag not in INLINE:
            self._end_line()
        self.tags += 1
        if tag in VOID:
            return
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):
            self._close_implied(tag)
        _, container, mark, inside, link, heading, reads = self._state()
        whole = tag in WHOLE
        overrules = whole and not inside and mark == BY_WORDS and not _mark(tag, attrs)
        if overrules:
            mark = 0
        elif not mark:
            if tag in OTHER_TAGS:
                mark = BY_MARKUP
            elif attrs and tag not in ("html", "body", "main"):
                mark = _mark(tag, attrs, ARTICLE_WORDS if whole else OTHER_WORDS)
        if not inside and (whole or tag in CONTAINERS):
            self.parents.append(container)
            container = len(self.parents) - 1
            if whole:
                self.articles.add(container)
            if overrules:
                self.overruled.add(container)
        self.places.setdefault(tag, []).append(len(self.open))
        if whole:
            self.wholes.append(len(self.open))
        if tag not in INLINE and tag != "p":
            self.blocks.append(len(self.open))
        self.open.append(Open(tag, container, mark, inside or whole, link or tag == "a", heading or tag in HEADINGS, reads or tag in READ))

    def _close(self, place: int) -> None:
        """Closes the open element at `place` and all inside it."""
        for k in range(len(self.open) - 1, place - 1, -1):
            self.places[self.open.pop().tag].pop()
            if self.wholes and self.wholes[-1] == k:
                self.wholes.pop()
            if self.blocks and self.blocks[-1] == k:
                self.blocks.pop()

    def _close_implied(self, tag: str) -> None:
        """A new paragraph, item or cell ends an open one of its kind, unless another block lies between."""
        places = self.places.get(tag)
        if places and (not self.blocks or places[-1] >= self.blocks[-1]):
            self._close(places[-1])

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag != "br":
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self._end_line()
        self.tags += 1
        places = self.places.get(tag)
        # A stray end tag doesn't close the article around it.
        if places and (tag in ("body", "html", "article", "main") or not self.wholes or places[-1] > self.wholes[-1]):
            self._close(places[-1])

    def handle_data(self, data: str) -> None:
        self.text.append(data)
        now = self._state()
        if now.link:
            self.links += len(" ".join(data.split()))
        if not data.isspace():
            self.heading = self.heading or now.heading
            self.reads = self.reads or now.reads

    def end(self) -> list[Line]:
        self.close()
        self._end_line()
        return self.lines


def _mark(tag: str, attrs: list[tuple[str, str | None]], others: frozenset = OTHER_WORDS) -> int:
    mark = 0
    for name, value in attrs:
        if name in ("class", "id"):
            for whole in (value or "").split():
                # Words lie between marks and changes of case, as in "siteFooter".
                words = [w.lower() for w in re.split(r"[_-]+|(?<=[a-z0-9])(?=[A-Z])", whole)]
                for before, word in zip(["", *words], words):
                    if word in others and before not in LAYOUT_WORDS and not (tag in HEADINGS and word in HEADING_WORDS):
                        mark = mark or BY_WORDS
        elif name == "role":
            if (value or "").strip().lower() in OTHER_ROLES:
                mark = BY_MARKUP
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            mark = BY_MARKUP
    return mark


def smooth(values: list[float], sigma: float = 1.0) -> list[float]:
    """Gaussian-weighted means over the neighbours within three sigma; weights are those of the lines that exist."""
    reach = math.ceil(3 * sigma)
    weights = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(reach + 1)]
    out = []
    for i in range(len(values)):
        near = range(max(0, i - reach), min(len(values), i + reach + 1))
        out.append(sum(values[j] * weights[abs(i - j)] for j in near) / sum(weights[abs(i - j)] for j in near))
    return out


def threshold(values: list[float], rounds: int = 20) -> float:
    """The border between two clusters of numbers: midway between the means of what lies above and below it."""
    border = sum(values) / len(values)
    for _ in range(rounds):
        high, low = [v for v in values if v >= border], [v for v in values if v < border]
        if not low:
            return border
        moved = (sum(high) / len(high) + sum(low) / len(low)) / 2
        if moved == border:
            break
        border = moved
    return border


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """The text of the content containers, lines joined by a blank; "" where there is none."""
    if not html:
        return ""
    parser = Lines()
    # Marked sections aren't HTML; like browsers, read them as comments up to the next ">".
    parser.feed(html.replace("<![", "<!-[") if "<![" in html else html)
    lines = parser.end()
    if parser.overruled:
        # An article in a zone marked by words counts if it is the bulk of the page, not if it is a teaser beside the text.
        held = sum(len(x.text) for x in lines if not x.mark and x.container in parser.overruled)
        rest = sum(len(x.text) - x.links for x in lines if not x.mark and x.container not in parser.overruled)
        if held < rest:
            lines = [x._replace(mark=x.mark or BY_WORDS) if x.container in parser.overruled else x for x in lines]
    ratios = [0.0 if x.mark else len(x.text) / max(1, x.tags) for x in lines]
    if not any(ratios):
        return ""
    smoothed = smooth(ratios, sigma)
    free = [s for s, r in zip(smoothed, ratios) if r > 0]
    border = min(threshold(smoothed), max(free))
    core = [r > 0 and s >= border for s, r in zip(smoothed, ratios)]
    inside = region(parser, lines, core)
    return " ".join(x.text for x in lines if not x.mark and inside[x.container])


def region(parser: Lines, lines: list[Line], core: list[bool]) -> list[bool]:
    """Which containers are content: see the head of this module."""
    n = len(parser.parents)
    held, chars, links, reading = [0] * n, [0] * n, [0] * n, [0] * n
    for x, high in zip(lines, core):
        if not x.mark:
            held[x.container] += len(x.text) * high
            if not x.heading:
                chars[x.container] += len(x.text)
                links[x.container] += x.links
            reading[x.container] += (x.reads or x.text.endswith(SENTENCE_END)) and 2 * x.links <= len(x.text)
    if 2 * sum(held[c] for c in parser.articles) >= sum(held):
        # A teaser of links isn't an article of its own.
        return [c in parser.articles and (held[c] > 0 or 2 * links[c] <= chars[c]) for c in range(n)]
    # Sums of whole subtrees: a container comes after the one around it.
    for c in range(n - 1, 0, -1):
        held[parser.parents[c]] += held[c]
        reading[parser.parents[c]] += reading[c]
    bulk = [0] * n  # of each container, the part with the most of the core
    for c in range(1, n):
        around = parser.parents[c]
        if not bulk[around] or held[c] > held[bulk[around]]:
            bulk[around] = c
    at = 0
    while bulk[at] and 100 * held[bulk[at]] >= BULK * held[0] and reading[bulk[at]] == reading[at]:
        at = bulk[at]
    inside = [False] * n
    for c in range(n):
        inside[c] = c == at or c > 0 and inside[parser.parents[c]]
    return [i and (c in parser.articles or 2 * links[c] <= chars[c]) for c, i in enumerate(inside)]


def extract(pages: DataFrame, sigma: float = 1.0) -> DataFrame:
    """`page_id, url, text, n_chars` for every row. Null html counts as empty; pages without content have empty text.

    Repeated rows and ids, and null ids, are read like others; other columns of any name are left out; an empty table gives no rows. The
    time for a page is in proportion to its length, whatever is open or unclosed in it, but for the standard library's own
    cost where tags break off (`<a ` over and over).
    """
    schema = "page_id bigint, url string, text string, n_chars bigint"

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            text = frame["html"].map(lambda html: main_text(html, sigma), na_action=None)
            yield pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": text, "n_chars": text.map(len)})

    narrow = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    return narrow.mapInPandas(batches, schema)
