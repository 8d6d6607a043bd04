r"""HTML extraction (8): text-to-tag ratios over streamed parser events.

The standard library's parser sends events; block-level tags end a line. Each stretch of characters belongs to the
element that it stands in, whatever is open when its line ends. Characters in elements that never hold main text (menus,
headers and footers of the page, asides, forms, scripts, styles, hidden ones) are left out, inside a line as well. A
line has its stretches, the number of tags in it and how much of its text is inside links. The text-to-tag ratios of the
lines, links not counted, are smoothed by a Gaussian and clustered by a threshold (their standard deviation, at most their mean): the lines
over it are the content cluster.

The cluster decides three times. An element whose class or id names a menu, advert, notice, comment list and the like
goes, unless it holds at least half of the cluster's text, and the article or main element if there is one: then it is
the frame of the content. Lines that are mostly links, several in a row and at most half of them in the cluster, are a
menu and go, in an article too. And beside an article or main element only lines of the cluster stay. All else stays,
short lines as well: a page without such an element loses nothing by where its lines stand.

Elements are numbers with a parent each, so that work and memory are linear in the page, however deep it is nested.

Results for special cases: null or empty html, and pages without text, give an empty text. Repeated rows give repeated
results. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import by_rows

BLOCKS = set("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
NEVER = set("head title script style noscript template iframe object svg canvas nav footer aside form button select textarea input dialog menu audio video".split())
#: Whole names (of class or id) that tell of something else than main text, with what may stand before and after.
BEFORE = "site page global main top bottom left right primary secondary post article js block user reader visitor customer google email inline sticky mobile desktop"
NAMES = (
    r"ads?|advert\w*|adsense|adbox|sponsor(?:ed|s|ship)?|promo(?:tion)?s?|banners?|nav|navbar|navigation|menus?|breadcrumbs?|masthead|footer|sidebar|aside|widgets?|comments?|commentlist|disqus|replies|respond|"
    r"cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommend(?:ed|ations?)|pagination|pager|toolbar|copyright|search"
)
AFTER = "area list bar box wrapper wrap container section block left right top bottom inner content links? buttons? form notice banner consent popup thread posts articles items? menu nav slot unit code \\d+"


def whole_name(names: str) -> re.Pattern:
    return re.compile(rf"(?:(?:{'|'.join(BEFORE.split())})[-_])*(?:{names})(?:[-_]?(?:{'|'.join(AFTER.split())}|{names}))*")


NAMED, HEADER = whole_name(NAMES), whole_name("header|head")
ROLES = set("navigation banner contentinfo complementary search alert dialog form menu menubar toolbar".split())
#: So many lines in a row that are mostly links are a menu, inside an article or main element and elsewhere.
MENU_INSIDE, MENU = 3, 2
#: An end tag closes these, when their kind follows without one.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
PARAGRAPH_ENDS = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())


class Line(NamedTuple):
    parts: list[tuple[str, int]]  # text and its element
    tags: int
    linked: int
    element: int  # the innermost block-level one

    def text(self, gone: Sequence[bool] = ()) -> str:
        return " ".join("".join(t for t, e in self.parts if not (gone and gone[e])).split())


class Lines(HTMLParser):
    """Collects the page's lines, and each element's parent and kind."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        #: Of each element: parent, tag, whether it is left out (or stands in one that is), whether its name is suspect.
        self.parent, self.tag, self.out, self.suspect = [0], [""], [False], [False]
        self.stack = [0]
        self.blocks: list[int] = []  # depths of the open block-level elements
        self.open: Counter = Counter()
        self.lines: list[Line] = []
        self.parts: list[tuple[str, int]] = []
        self.tags = self.linked = 0

    def end_line(self):
        if any(not t.isspace() for t, _ in self.parts):
            self.lines.append(Line(self.parts, self.tags, self.linked, self.stack[self.blocks[-1]] if self.blocks else 0))
        self.parts, self.tags, self.linked = [], 0, 0

    def pop_to(self, depth: int):
        for element in self.stack[depth:]:
            self.open[self.tag[element]] -= 1
        del self.stack[depth:]
        while self.blocks and self.blocks[-1] >= depth:
            self.blocks.pop()

    def close(self):
        super().close()
        self.end_line()

    def kind(self, tag: str, attrs) -> tuple[bool, bool]:
        """Whether the element is left out, and whether its name is suspect."""
        if self.out[self.stack[-1]] or tag in NEVER:
            return True, False
        inside = self.open["article"] > 0 or self.open["main"] > 0
        if tag == "header":  # an article's own header holds its title
            return not inside, False
        if tag in ("html", "body", "article", "main"):
            return False, False
        known = {k: (v or "").lower() for k, v in attrs}
        if known.get("role") in ROLES or "hidden" in known or known.get("aria-hidden") == "true" or "display:none" in known.get("style", "").replace(" ", ""):
            return True, False
        names = [*known.get("class", "").split(), *known.get("id", "").split()]
        return False, any(NAMED.fullmatch(n) or (not inside and HEADER.fullmatch(n)) for n in names)

    def handle_starttag(self, tag, attrs):
        block, left_out = tag in BLOCKS, self.out[self.stack[-1]]
        if block and not left_out:
            self.end_line()
        if tag in PARAGRAPH_ENDS:
            self.close_tag({"p"})
        if tag in CLOSES:
            self.close_tag(CLOSES[tag])
        self.tags += not block and not left_out
        if tag in VOID:
            return
        out, suspect = self.kind(tag, attrs)
        self.parent.append(self.stack[-1])
        self.tag.append(tag)
        self.out.append(out)
        self.suspect.append(suspect)
        self.open[tag] += 1
        if block:
            self.blocks.append(len(self.stack))
        self.stack.append(len(self.tag) - 1)

    def close_tag(self, kinds: set[str]):
        """Closes an open element of these kinds, unless a container stands between."""
        for depth in reversed(self.blocks):
            name = self.tag[self.stack[depth]]
            if self.out[self.stack[-1]] and not self.out[self.stack[depth]]:
                return None
            if name in kinds:
                return self.pop_to(depth)
            if name != "p":
                return None
        return None

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS and not self.out[self.stack[-1]]:
            self.end_line()
        if self.open[tag] > 0:
            depth = len(self.stack) - 1
            while self.tag[self.stack[depth]] != tag:
                depth -= 1
            self.pop_to(depth)

    def handle_data(self, data):
        element = self.stack[-1]
        if not self.out[element]:
            self.parts.append((data, element))
            if self.open["a"] > 0:
                self.linked += len(data.strip())


def smooth(values: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    return np.convolve(np.pad(values, reach, mode="edge"), kernel, mode="valid")


def cluster(lines: Sequence[Line], texts: Sequence[str]) -> np.ndarray:
    """Whether each line is over the threshold of the smoothed ratios of text outside of links to tags."""
    smoothed = smooth(np.array([max(0, len(text) - x.linked) / max(1, x.tags) for x, text in zip(lines, texts, strict=True)], float))
    return smoothed >= min(smoothed.std(), smoothed.mean())


def menus(links: Sequence[bool], inside: Sequence[bool], dense: Sequence[bool]) -> list[bool]:
    """Which lines are in a run of enough lines of links, at most half of them in the cluster."""
    out, start = [False] * len(links), 0
    for n in range(len(links) + 1):
        if n == len(links) or links[n] != links[start] or inside[n] != inside[start]:
            run = n - start if start < n and links[start] else 0
            if run and run >= (MENU_INSIDE if inside[start] else MENU) and 2 * sum(dense[start:n]) <= run:
                out[start:n] = [True] * run
            start = n
    return out


def main_text(html: str) -> str:
    page = Lines()
    page.feed(html)
    page.close()
    size, lines = len(page.tag), page.lines
    if not lines:
        return ""
    frames = [page.tag[e] in ("article", "main") and not page.out[e] for e in range(size)]
    gone = [False] * size
    if any(page.suspect):
        held, framed = [0] * size, list(frames)
        for line, dense in zip(lines, cluster(lines, [x.text() for x in lines]), strict=True):
            for text, element in line.parts:
                held[element] += len(text.strip()) * bool(dense)
        for element in range(size - 1, 0, -1):
            held[page.parent[element]] += held[element]
            framed[page.parent[element]] |= framed[element]
        for element in range(1, size):
            frame = 2 * held[element] >= held[0] and (framed[element] or not framed[0])
            gone[element] = gone[page.parent[element]] or (page.suspect[element] and not frame)
    for element in range(1, size):
        frames[element] |= frames[page.parent[element]]
    kept = [(x, text) for x in lines if (text := x.text(gone))]
    if not kept:
        return ""
    dense = cluster(*zip(*kept, strict=True))
    inside = [frames[x.element] for x, _ in kept]
    menu = menus([2 * x.linked > len(t) for x, t in kept], inside, dense.tolist())
    beside = any(inside)
    return "\n".join(t for n, (_, t) in enumerate(kept) if not menu[n] and (inside[n] or not beside or dense[n]))


def extract(pages: DataFrame, id_column: str = "page_id") -> DataFrame:
    """id, url, text."""
    kind = pages.schema[id_column].dataType.simpleString()

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in by_rows(frames):
            yield pd.DataFrame({id_column: frame[id_column].to_numpy(), "url": frame["url"].to_numpy(), "text": [main_text(h) for h in frame["_html"]]})

    source = pages.select(id_column, "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("_html"))
    return source.mapInPandas(of, f"`{id_column}` {kind}, url string, text string")
