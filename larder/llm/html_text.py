"""HTML extraction (operator 1): main text from parser events.

Method: the page is streamed in chunks through the standard library's
``HTMLParser``; its events fill *lines* (runs of text between block-level
tags) with their number of tags and the nearest sectioning ancestor.  Each
line's text-to-tag ratio is smoothed over its neighbours with a Gaussian
kernel, a two-means threshold splits lines into content and the rest, and
the regions (an ``article``/``main``, else the nearest container) that the
content lines mark are returned whole, so that short paragraphs between
long ones stay.  Elements that HTML itself marks as something other than the
article (menus, footers, forms, scripts ...) never fill a line, nor do
elements whose class, id or role hints at that; but a hinted element that
turns out to hold ``main``, the article or most of the text is only a wrapper
with a misleading name, and its hint is ignored.

Defined results: null or empty html, or a page without text, gives ''.
Unclosed, misnested and cut-off tags are repaired as a browser would; a tag
cut off by the end of the page is dropped.  Repeated pages give equal text.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

CHUNK = 1 << 16
SIGMA = 1.0

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset(
    "nav footer aside form script style noscript template head title iframe object svg canvas "
    "button select option textarea menu dialog audio video".split())
CONTAINERS = frozenset(
    "html body article main section div td th table header nav footer aside form".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = CONTAINERS | HEADINGS | frozenset(
    "p ul ol li dl dt dd tr caption thead tbody tfoot blockquote pre figure figcaption address "
    "details summary fieldset legend hr center".split())
CLOSED_BY_BLOCK = frozenset("p".split())
# Words in class, id or role that mark something other than the article.
HINTS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar footer header masthead "
    "banner ad ads advert adverts advertisement advertising sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice notices newsletter subscribe signup popup modal overlay "
    "comment comments reply replies disqus respond share sharing social related recommended "
    "widget toolbar pagination pager copyright login search contentinfo complementary "
    "alert dialog aside hidden".split())
ARTICLE_HINTS = frozenset("comment comments reply ad ads advert sponsored promo related".split())
_SPLIT = re.compile(r"[^a-z0-9]+")
_STATE_CLASS = re.compile(r"^(has|with|no|without|is)[-_]")


HEADER_HINTS = frozenset("header masthead".split())


def _hidden(tag: str, attrs) -> bool:
    if tag in HEADINGS or tag in ("html", "body", "main"):
        return False
    return any(name == "hidden" or (name == "aria-hidden" and value == "true")
               or (name == "style" and value
                   and "display:none" in value.replace(" ", "").lower())
               for name, value in attrs)


def _hints(tag: str, attrs) -> frozenset:
    """Words of class, id and role that mark something other than the article."""
    if tag in HEADINGS or tag in ("html", "body", "main"):
        return frozenset()
    wanted = ARTICLE_HINTS if tag == "article" else HINTS
    return frozenset(word for name, value in attrs if name in ("class", "id", "role") and value
                     for part in value.lower().split() if not _STATE_CLASS.match(part)
                     for word in _SPLIT.split(part) if word in wanted)


class LineParser(HTMLParser):
    """Collects ``lines``: [text, tags, region, article?, link characters]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        # lines before hints are decided: [pieces, tags since the line before, region, article?]
        self.raw: list[tuple[list, int, int, bool]] = []
        # open elements: (tag, skipped, region id, inside an article, inside a header of it)
        self.open: list[tuple[str, bool, int, bool, bool]] = [("", False, 0, False, False)]
        # pieces of text: (text, hinted elements it is in, link characters)
        self.text: list[tuple[str, tuple, int]] = []
        self.within: list[tuple] = [()]         # hinted elements around each open element
        self.soft: list[frozenset] = []         # the hints of each hinted element
        self.wraps: set[int] = set()            # hinted elements with main inside
        self.articles: list[list] = []          # [hinted elements around it, characters]
        self.article_of: list[int] = [-1]       # article of each open element
        self.size: dict[tuple, int] = {}        # characters by hinted elements around them
        self.tags = 0
        self.in_link = 0
        self.n_regions = 0

    def flush(self):
        if self.text:
            _, _, region, article, _ = self.open[-1]
            self.raw.append((self.text, self.tags, region, article))
            self.text, self.tags = [], 0

    def misleading(self) -> set[int]:
        """Hinted elements that hold main, the article or most of the page's text."""
        page = sum(self.size.values())
        own = [0] * len(self.soft)
        for around, n in self.size.items():
            for h in around:
                own[h] += n
        longest = [0] * len(self.soft)
        for around, n in self.articles:
            for h in around:
                longest[h] = max(longest[h], n)
        return {h for h, words in enumerate(self.soft) if h in self.wraps
                or (words.isdisjoint(ARTICLE_HINTS) and own[h]
                    and (2 * own[h] > page or longest[h] > page - own[h]))}

    @property
    def lines(self) -> list[tuple[str, int, int, bool, int]]:
        spared, tags, out = self.misleading(), 0, []
        for pieces, more, region, article in self.raw:
            tags += more
            pieces = [p for p in pieces if spared.issuperset(p[1])]
            text = " ".join("".join(p[0] for p in pieces).split())
            if text:
                out.append((text, max(1, tags), region, article, sum(p[2] for p in pieces)))
                tags = 0
        return out

    def _pop_to(self, tag: str):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                del self.open[i:], self.within[i:], self.article_of[i:]
                return
            if tag not in CONTAINERS and self.open[i][0] in CONTAINERS:
                return

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "br":
            self.text.append((" ", (), 0))
        if tag in BLOCKS:
            self.flush()
            self._pop_to("p")
            if tag == "li":
                for name, *_ in reversed(self.open):
                    if name in ("ul", "ol") or name in CONTAINERS:
                        break
                    if name == "li":
                        self._pop_to("li")
                        break
        if tag in VOID:
            return
        _, skipped, region, article, in_header = self.open[-1]
        if tag in ("article", "main") and not article:
            article, in_header = True, False
            self.n_regions += 1
            region = self.n_regions
        elif tag in CONTAINERS and not article:
            self.n_regions += 1
            region = self.n_regions
        hints, around, own = _hints(tag, attrs), self.within[-1], self.article_of[-1]
        if tag == "header" or (article and hints and hints <= HEADER_HINTS):
            in_header = article
            skipped = skipped or not article
            hints = hints - HEADER_HINTS
        skipped = skipped or tag in SKIPPED or _hidden(tag, attrs)
        if tag == "main" and not skipped:
            self.wraps.update(around)
        if hints:
            around = (*around, len(self.soft))
            self.soft.append(hints)
        elif tag == "article" and not skipped:
            own = len(self.articles)
            self.articles.append([around, 0])
        self.open.append((tag, skipped, region, article, in_header))
        self.within.append(around)
        self.article_of.append(own)
        if tag == "a":
            self.in_link += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag == "a":
            self.in_link = max(0, self.in_link - 1)
        if tag in BLOCKS:
            self.flush()
        self._pop_to(tag)

    def handle_data(self, data):
        _, skipped, _, _, in_header = self.open[-1]
        if skipped or (in_header and not any(e[0] in HEADINGS for e in self.open)):
            return
        n = len(data.strip())
        around = self.within[-1]
        self.size[around] = self.size.get(around, 0) + n
        if self.article_of[-1] >= 0:
            self.articles[self.article_of[-1]][1] += n
        self.text.append((data, around, n if self.in_link else 0))


def _smooth(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    radius = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(x)), kernel)[radius:radius + len(x)]
    return np.convolve(x, kernel)[radius:radius + len(x)] / weight


def _threshold(x: np.ndarray) -> float:
    """Two-means split point; at or below the minimum if all values are alike."""
    lo, hi = float(x.min()), float(x.max())
    for _ in range(50):
        cut = (lo + hi) / 2
        low, high = x[x < cut], x[x >= cut]
        if not len(low) or not len(high):
            break
        new = float(low.mean()), float(high.mean())
        if new == (lo, hi):
            break
        lo, hi = new
    return (lo + hi) / 2


# An element left unfinished by the end of the page.
_CUT_TAG = re.compile(r"<(?:/?[A-Za-z][^<>]*|!--(?:(?!-->).)*|![^<>]*|/)?\Z", re.S)


def extract(html: str | None) -> str:
    """Main text of one page: blocks in page order, joined by one newline."""
    if not html:
        return ""
    parser = LineParser()
    tail = html.rfind("<")
    if tail >= 0 and (cut := _CUT_TAG.match(html, tail)):
        html = html[:cut.start()]
    for i in range(0, len(html), CHUNK):
        parser.feed(html[i:i + CHUNK])
    parser.close()
    parser.flush()
    lines = parser.lines
    if not lines:
        return ""
    ratio = np.array([len(t) / n for t, n, *_ in lines])
    smooth = _smooth(np.log1p(ratio))
    content = smooth >= _threshold(smooth)
    in_article = np.array([x[3] for x in lines])
    if in_article.any():
        regions = {x[2] for x, c in zip(lines, content) if c and x[3]}
        regions = regions or {max((x for x in lines if x[3]), key=lambda x: len(x[0]))[2]}
        return "\n".join(x[0] for x in lines if x[2] in regions)
    regions = {x[2] for x, c in zip(lines, content) if c}
    kept = [x[0] for x in lines if x[2] in regions and x[4] <= 0.8 * len(x[0])]
    return "\n".join(kept)


@F.pandas_udf(StringType())
def _extract_udf(html: pd.Series) -> pd.Series:
    return html.map(extract, na_action=None)


def main_text(html: Column) -> Column:
    """Column with the main text of the pages in column ``html``."""
    return F.coalesce(_extract_udf(html), F.lit(""))


def extract_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every page; other columns are not read."""
    out = pages.select("page_id", "url", main_text(F.col(html)).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
