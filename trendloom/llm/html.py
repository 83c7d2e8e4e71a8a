"""Main text of web pages from a stream of parser events.

Block elements cut a page into lines. Each line has a ratio of its text, links
not counted, to its tags; the ratios are smoothed with a Gaussian, and runs of
lines above a threshold are clusters. The cluster of most text, and others that
come near it, are the article; lines at their edges that are neither dense nor
a sentence nor a heading are cut off. What a page says by its elements adds to
that: an article element that holds most of the clusters' text is taken whole,
and parts marked as something else (menus, forms, adverts, comments and so on)
are left out before.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame, functions as F

from trendloom.llm.common import map_texts

#: Width of the Gaussian, in lines, and lines that it reaches.
SIGMA, REACH = 1.0, 3
#: Content lines have a smoothed ratio of at least this share of its standard deviation.
THRESHOLD = 0.5
#: Clusters of at least this share of the largest one's text are kept too, as are those of its innermost element.
SHARE = 0.25
#: Lines at an edge are weak below this share of the page's ratio, each line weighted by its text.
WEAK = 0.2
#: List items in a row, all of them links, that make a menu.
MENU = 3

# fixed values: names of elements, roles and words of class names
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split())
CONTAINERS = frozenset("article body div main section table tbody td tr".split())
ARTICLES = frozenset(("article", "main"))
REPEATING = frozenset("dd dt li option p td th tr".split())
SKIPPED = frozenset(
    "aside button dialog footer form head iframe menu nav noscript object script select style svg template textarea "
    "title".split())
SKIPPED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu navigation search".split())
SKIPPED_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "copyright disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pager "
    "pagination popup promo related replies search share sharing sidebar signup social sponsor sponsored subscribe "
    "toolbar widget".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SENTENCE = re.compile(r"""[.!?…:;。！？]["'”’»)\]]*$""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _marked(attributes: list[tuple[str, str | None]]) -> bool:
    """Whether the attributes name a part that is no article."""
    for name, value in attributes:
        if not value:
            continue
        if name == "role" and value.lower() in SKIPPED_ROLES:
            return True
        if name in ("class", "id") and any(w.lower() in SKIPPED_WORDS for w in _WORD.findall(value)):
            return True
    return False


class Lines(HTMLParser):
    """Lines of a page: text, characters in links, tags, list item or not, heading or not, and the elements around it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, bool, bool, tuple[int, ...]]] = []
        #: Open elements: name, number of its container (0: none), what it hides.
        self.open: list[tuple[str, int, bool]] = []
        self.names: dict[str, int] = {}
        self.containers: list[str] = [""]
        self.around: tuple[int, ...] = ()
        self.hidden = 0
        self.parts: list[str] = []
        self.linked = self.tags = 0

    def cut(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            heading = any(self.names.get(h) for h in HEADINGS)
            self.lines.append((text, self.linked, self.tags, self.names.get("li", 0) > 0, heading, self.around))
        self.parts, self.linked, self.tags = [], 0, 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in INLINE:
            self.cut()
        self.tags += 1
        if tag in VOID:
            return
        if tag in REPEATING and self.open and self.open[-1][0] == tag:
            self.pop()
        inside = any(self.names.get(a) for a in ARTICLES)
        if tag in ARTICLES and self.hidden and not inside and not self.names.get("aside"):
            # a menu or form that never ended
            while self.open and self.hidden:
                self.pop()
        hides = tag in SKIPPED or (tag == "header" and not inside)
        if not hides and tag not in ("html", "body") and tag not in ARTICLES:
            hides = _marked(attrs)
        elif tag in ARTICLES and inside:
            hides = _marked(attrs)
        number = 0
        if tag in CONTAINERS:
            self.containers.append(tag)
            number = len(self.containers) - 1
            self.around += (number,)
        self.open.append((tag, number, hides))
        self.names[tag] = self.names.get(tag, 0) + 1
        self.hidden += hides

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def pop(self) -> str:
        tag, number, hides = self.open.pop()
        self.names[tag] -= 1
        self.hidden -= hides
        if number:
            self.around = self.around[:-1]
        return tag

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.cut()
        self.tags += 1
        if not self.names.get(tag):
            return
        if tag not in ARTICLES and tag not in ("body", "html"):
            # an end tag inside an article ends nothing outside of it
            for name, _, _ in reversed(self.open):
                if name == tag:
                    break
                if name in ARTICLES:
                    return
        while self.pop() != tag:
            pass

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        self.parts.append(data)
        if self.names.get("a"):
            self.linked += len(data.strip())


def lines_of(html: str) -> list[tuple[str, int, int, bool, bool, dict[int, str]]]:
    """Lines as `Lines` has them, with the names of the containers around by number."""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.cut()
    return [(*line[:5], {i: parser.containers[i] for i in line[5]}) for line in parser.lines]


def smoothed(ratios: np.ndarray, sigma: float = SIGMA, reach: int = REACH) -> np.ndarray:
    places = np.arange(-reach, reach + 1)
    weights = np.exp(-(places / sigma) ** 2 / 2)
    total = np.convolve(ratios, weights)[reach:reach + len(ratios)]
    return total / np.convolve(np.ones(len(ratios)), weights)[reach:reach + len(ratios)]


def _menus(lines: list) -> set[int]:
    """Lines of list items that are links, MENU or more in a row."""
    found, run = set(), []
    for i, line in enumerate([*lines, None]):
        if line is not None and line[3] and line[1] >= len(line[0]):
            run.append(i)
            continue
        if len(run) >= MENU:
            found.update(run)
        run = []
    return found


def clusters(ratios: np.ndarray) -> tuple[list[tuple[int, int]], float]:
    """Runs (first line, line behind the last) of smoothed ratios at or above the threshold, and the threshold."""
    level = smoothed(ratios)
    least = THRESHOLD * float(level.std())
    steps = np.diff(np.concatenate([[False], level >= least, [False]]).astype(np.int8))
    return list(zip(np.flatnonzero(steps == 1).tolist(), np.flatnonzero(steps == -1).tolist(), strict=True)), least


def content_lines(lines: list) -> list[int]:
    """Places of the lines that the clusters choose."""
    own = [max(0, len(line[0]) - line[1]) for line in lines]
    ratios = np.array([n / max(1, line[2]) for n, line in zip(own, lines, strict=True)])
    runs, least = clusters(ratios)

    least = max(least, WEAK * float(np.average(ratios, weights=own))) if any(own) else least

    def weak(i: int) -> bool:
        """Neither dense nor a sentence nor a heading."""
        text, linked, _, _, heading, _ = lines[i]
        return not heading and (ratios[i] < least or linked * 2 > len(text)) and not (own[i] and _SENTENCE.search(text))

    cut = []
    for first, end in runs:
        while first < end and weak(first):
            first += 1
        while first < end and weak(end - 1):
            end -= 1
        if first < end:
            cut.append((first, end))
    if not cut:
        return []
    weights = [sum(own[a:b]) for a, b in cut]
    main = cut[weights.index(max(weights))]
    home = max(set(lines[main[0]][5]).intersection(*(lines[i][5] for i in range(*main))), default=0)
    inside = {i for i, line in enumerate(lines) if home and lines[main[0]][5][home] != "body" and home in line[5]}
    kept = [c for c, w in zip(cut, weights, strict=True) if w >= SHARE * max(weights) or inside.issuperset(range(*c))]
    first, end = kept[0][0], kept[-1][1]
    # an article goes on over short lines: its headings before, and sentences of the same element
    while first and (lines[first - 1][4] or first - 1 in inside and not weak(first - 1)):
        first -= 1
    while end < len(lines) and end in inside and not weak(end):
        end += 1
    chosen = {i for a, b in kept for i in range(a, b)}
    return [i for i in range(first, end) if i in chosen or 2 * lines[i][1] <= len(lines[i][0])]


def main_text(html: str | None) -> str:
    """The article's lines in page order, joined by one space; empty if there is none."""
    lines = lines_of(html) if html else []
    menus = _menus(lines)
    lines = [line for i, line in enumerate(lines) if i not in menus]
    if not lines:
        return ""
    chosen = content_lines(lines) or range(len(lines))
    total = sum(len(lines[i][0]) for i in chosen)
    held: dict[int, int] = {}
    for i in chosen:
        for n, name in lines[i][5].items():
            if name in ARTICLES:
                held[n] = held.get(n, 0) + len(lines[i][0])
    # numbers grow inwards: the outermost that holds most of the text, else all if they do together
    marked = [n for n, size in sorted(held.items()) if 2 * size > total][:1]
    if not marked and 2 * sum(len(lines[i][0]) for i in chosen if not lines[i][5].keys().isdisjoint(held)) > total:
        marked = list(held)
    if marked:
        return " ".join(line[0] for line in lines if not line[5].keys().isdisjoint(marked))
    # elements marked as articles that hold little are others, such as teasers
    return " ".join(lines[i][0] for i in chosen if lines[i][5].keys().isdisjoint(held))


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points of the text), one row per input row.

    A null or empty html, and a page of which nothing is article, give an
    empty text. Other columns are ignored.
    """
    def run(rows):
        for key, address, data in rows:
            text = main_text(data.decode() if data else None)
            yield key, address, text, len(text)

    pages = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return map_texts(pages, run, "page_id bigint, url string, text string, n_chars bigint")
