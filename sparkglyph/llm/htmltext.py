"""Main text of raw web pages.

The standard library's streaming parser turns a page into lines, one per block,
each with its text length and the tags it took. The logarithms of the
text-to-tag ratios of all lines are smoothed with a Gaussian, weighted by where
a line stands (up in an article or main element, down in menus, footers, forms
and the like), and clustered by the threshold that parts them best. Runs of
lines of the content cluster, over short gaps and with the headings before
them, are the content regions. Of
their lines, those in boilerplate elements are left out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Not text at all, with all they hold.
SILENT = frozenset("head script style noscript template iframe svg canvas object select textarea option button".split())
#: Boilerplate elements.
BOILERPLATE = frozenset("nav header footer aside form menu dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start or end of these ends a block.
BLOCKS = frozenset(
    "address article aside blockquote body br dd details div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Names in class, id or role attributes that mark boilerplate, as whole tokens or with a part before or behind.
MARKS = re.compile(
    r"(?:[a-z0-9]+[_-])*(?:ads?|advert\w*|banners?|breadcrumbs?|captcha|comments?|comment-?(?:list|form|area|section)|consent|cookies?|copyright|disclaimer|disqus|footer|gdpr|masthead|menu|nav|nav-?(?:bar|list)|navigation|newsletter|notice|notification|pager|pagination|popup|promo|recommend(?:ed|ations)|related|replies|share|sharing|side-?bar|site-?info|social|sponsor(?:ed)?|subscribe|toolbar|top-?bar)(?:[_-](?:box|container|wrapper|block|area|list|links?|items?|content|section|form|bar|unit|slot|\d+))*",
    re.I,
)
#: Tokens that say what a page has or lacks, not what an element is.
NO_MARK = re.compile(r"(?:has|no|with|without|is|not|hide|show|page|layout|single)[_-]", re.I)
SPACE = re.compile(r"\s+")
SIGMA = 0.75
#: What a place weighs: lines in an article or main element count so much more, lines in boilerplate so much less.
ARTICLE, JUNK = math.log(3), math.log(8)
#: Clusters whose mean ratios differ by less than this factor are one.
APART = math.log(3)
#: Lines between two of the content cluster that still belong to their region.
GAP = 2


def _marked(attrs: list) -> bool:
    tokens = [t for k, v in attrs if k in ("class", "id", "role") and v for t in v.split()]
    return any(MARKS.fullmatch(t) and not NO_MARK.match(t) for t in tokens)


class _Lines(HTMLParser):
    """Streams parser events into lines of (text, tags, in an article or main element, a heading, boilerplate elements around it).

    Elements left open end where their parent does, stray ends are passed over,
    and of elements marked by name only, ``marked`` has the text each holds.
    """

    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, bool, bool, tuple[int, ...]]] = []
        self.text: list[str] = []
        self.tags = 0
        self.open: list[tuple[str, bool, int]] = []  # tag, silent, number of a boilerplate element or 0
        self.silent = self.article = self.made = 0
        self.marked: dict[int, int] = {}

    def flush(self) -> None:
        if self.text or self.tags:
            if text := SPACE.sub(" ", "".join(self.text)).strip():
                around = tuple(n for _, _, n in self.open if n)
                self.lines.append((text, self.tags, self.article > 0, any(t in HEADINGS for t, *_ in self.open), around))
                for n in around:
                    if n in self.marked:
                        self.marked[n] += len(text)
                self.tags = 0
            self.text = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        if tag in VOID:
            return
        # an unclosed p, li, ... ends where the next one begins
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and self.open and self.open[-1][0] == tag:
            self._pop()
        marked = tag not in ("html", "body", "main", "article") and _marked(attrs)
        # an article's own heading is text
        plain = tag in BOILERPLATE and not (tag == "header" and self.article)
        number = 0
        if marked or plain:
            if tag not in BLOCKS:
                self.flush()
            self.made += 1
            number = self.made
            if not plain:
                self.marked[number] = 0
        silent = tag in SILENT
        self.open.append((tag, silent, number))
        self.silent += silent
        self.article += tag in ("article", "main")

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        if any(t == tag for t, *_ in self.open):
            while self._pop() != tag:
                pass

    def parse_html_declaration(self, i: int) -> int:
        """Marked sections other than closed CDATA are comments up to the next '>', of which the base class refuses some."""
        if not self.rawdata.startswith("<![", i):
            return super().parse_html_declaration(i)
        if self.rawdata[i : i + 9].lower() == "<![cdata[" and (k := super().parse_html_declaration(i)) >= 0:
            return k
        return self.parse_bogus_comment(i)

    def _pop(self) -> str:
        tag, silent, number = self.open[-1]
        if number:
            self.flush()
        self.open.pop()
        self.silent -= silent
        self.article -= tag in ("article", "main")
        return tag

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.text.append(data)


def smooth(ratios: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian over neighbouring lines, weights renormalised at the ends."""
    reach = max(1, math.ceil(2 * sigma))
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(ratios)):
        got = [(k, ratios[i + d]) for k, d in zip(kernel, range(-reach, reach + 1)) if 0 <= i + d < len(ratios)]
        out.append(sum(k * r for k, r in got) / sum(k for k, _ in got))
    return out


def threshold(scores: list[float]) -> float:
    """The least score of the upper of two clusters, parted where the variance between them is largest; of all, if they are one."""
    order = sorted(scores)
    n, total = len(order), sum(order)
    best, at, low = -1.0, 0, 0.0
    for i in range(1, n):
        low += order[i - 1]
        gap = (total - low) / (n - i) - low / i
        if order[i] > order[i - 1] and gap >= APART and gap * gap * i * (n - i) > best:
            best, at = gap * gap * i * (n - i), i
    return order[at]


def regions(scores: list[float], headings: list[bool]) -> list[bool]:
    """Lines in a content region: those of the upper cluster, at most GAP others between two of them, and the headings right before."""
    least = threshold(scores)
    inside = [s >= least for s in scores]
    high = [i for i, x in enumerate(inside) if x]
    for a, b in zip(high, high[1:]):
        if b - a - 1 <= GAP:
            inside[a:b] = [True] * (b - a)
    for i in range(len(scores) - 2, -1, -1):
        inside[i] |= headings[i] and inside[i + 1]
    return inside


def extract(html: str | None) -> str:
    """Main text of one page: blocks in order, joined by a space.

    Null and empty html, and pages of markup alone, give an empty text.
    Malformed markup is read as it comes: unknown declarations are comments,
    elements left open end with their parent or the page.
    """
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    lines = parser.lines
    if not lines:
        return ""
    # an element that holds most of the text is no boilerplate for its name
    half = sum(len(text) for text, *_ in lines) / 2
    kept = {n for n, held in parser.marked.items() if held > half}
    junk = [any(n not in kept for n in around) for *_, around in lines]
    ratios = smooth([math.log1p(len(text) / max(1, tags)) for text, tags, *_ in lines])
    scores = [r + (-JUNK if bad else ARTICLE if article else 0.0) for r, (_, _, article, _, _), bad in zip(ratios, lines, junk)]
    inside = regions(scores, [heading for *_, heading, _ in lines])
    return " ".join(text for (text, *_), here, bad in zip(lines, inside, junk) if here and not bad)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page; whole pages, nothing capped.

    Null or empty html gives an empty text; null ids and urls and repeated rows
    pass through; other columns, whatever their names, are ignored; an empty
    table gives an empty one.
    """
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for html in batches:
            yield html.map(extract)

    text = F.pandas_udf(run, "string")(F.coalesce("html", F.lit("")))
    return pages.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
