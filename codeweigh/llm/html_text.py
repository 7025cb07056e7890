"""Main text of web pages: text-to-tag ratios over streamed parser events.

The standard library's parser is fed in pieces; its events make lines, one
per block of the page.  A line has a text-to-tag ratio: its characters outside
links divided by the tags met since the line before.  The ratios are smoothed
with a Gaussian over neighbouring lines, and lines at or above the standard
deviation of the smoothed ratios (or their mean, if that is less) form the
content cluster.  Lines belong to
regions (the nearest enclosing sectioning or weak element); a region is content if
the cluster holds at least half of its characters, and then all its lines are
kept, so short paragraphs and headings stay.  Where the cluster reaches into
``article`` or ``main`` elements, only these count, with all nested in them that is not weak.

Names decide nothing alone: the elements of ``WEAK`` and elements whose class, id
or role says so (``HINTS``) are *weak*, and the smoothed ratio of a line counts
``LESS`` as much for each weak element around it.  An element around nearly
all (``NEARLY_ALL``) of the page's text is not weak (a page in one form, a wrapper called
``has-sidebar``), nor is one around half of it that is or holds an ``article`` or
``main``, nor the ``header`` of one.  Only what shows no running text
(``DROPPED``, hidden elements) is left out beforehand.

Rows: null, empty and text-free html gives an empty text; an unfinished tag at
the end is no text; unclosed elements end with the page; repeated rows give
equal results.  Nothing else is dropped or cut, however long the page.  An
empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from codeweigh.llm.common import documents, map_rows

PIECE = 1 << 16
SIGMA = 1.0
RADIUS = 2
LESS = 0.05
NEARLY_ALL = 0.9

#: Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head script style noscript template button select textarea iframe object svg canvas audio video title".split())
WEAK = frozenset("nav header footer aside form menu dialog".split())
REGIONS = frozenset("body article main section div td".split())
BLOCKS = frozenset("address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html legend li main ol p pre section summary table tbody td tfoot th thead tr ul".split()) | DROPPED | WEAK
#: Words of class, id and role attributes that name boilerplate.
HINTS = frozenset("""ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies
 dialog disqus footer header hidden menu modal nav navbar navigation navigator newsletter notice notification overlay popup promo promoted promotion
 related search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget complementary contentinfo alert""".split())
_WORDS = re.compile(r"[a-z]+")


def _is_hinted(attrs: list[tuple[str, str | None]]) -> bool:
    for name, value in attrs:
        if name in ("class", "id", "role") and value and not HINTS.isdisjoint(_WORDS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower())):
            return True
    return False


def _is_hidden(attrs: list[tuple[str, str | None]]) -> bool:
    return any(name == "hidden" or (name == "aria-hidden" and value == "true") for name, value in attrs)


class Lines(HTMLParser):
    """Collects (text, link characters, tags, region) per block."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []
        self.regions: list[tuple[str, int, bool]] = [("body", -1, False)]  # name, parent, whether its names call it weak
        self.open: list[tuple[str, bool, int]] = []  # name, dropped, region
        self.region, self.skipping, self.links = 0, 0, 0
        self.text: list[str] = []
        self.in_links, self.tags = 0, 0

    def end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.in_links, self.tags, self.region))
            self.tags = 0
        self.text, self.in_links = [], 0

    def handle_starttag(self, tag, attrs):
        self.tags += not self.skipping
        if tag in BLOCKS:
            self.end_line()
            if tag == "p" or tag == "li":
                self._close(tag, until=REGIONS | {"ul", "ol", "blockquote", "table"})
        elif tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        inner = tag not in ("html", "body")
        dropped = tag in DROPPED or (inner and _is_hidden(attrs))
        weak = tag in WEAK or (inner and _is_hinted(attrs))
        if tag == "a":
            self.links += 1
        self.open.append((tag, dropped, self.region))
        self.skipping += dropped
        if weak and tag not in BLOCKS:
            self.end_line()
        if weak or (tag in REGIONS and tag != "body"):
            self.regions.append((tag, self.region, weak))
            self.region = len(self.regions) - 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "path", "iframe", "script"):
            self._close(tag)

    def handle_endtag(self, tag):
        self.tags += not self.skipping
        if tag in BLOCKS:
            self.end_line()
        self._close(tag)

    def _close(self, tag: str, until: frozenset | set = frozenset()) -> None:
        for at in range(len(self.open) - 1, -1, -1):
            name = self.open[at][0]
            if name == tag:
                for name, dropped, region in reversed(self.open[at:]):
                    if region != self.region and name not in BLOCKS:  # a weak element inside a line
                        self.end_line()
                    self.skipping -= dropped
                    self.links -= name == "a"
                    self.region = region
                del self.open[at:]
                return
            if name in until:
                return

    def handle_data(self, data):
        if not self.skipping:
            self.text.append(data)
            if self.links:
                self.in_links += len(data)


def smoothed(ratio: np.ndarray) -> np.ndarray:
    k = np.exp(-np.arange(-RADIUS, RADIUS + 1) ** 2 / (2 * SIGMA ** 2))
    return np.convolve(np.pad(ratio, RADIUS, "edge"), k / k.sum(), "valid")


def weakness(regions: list[tuple[str, int, bool]], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weak elements around each region, those around its article or -1 outside); ``plain``
    counts the characters outside links of each region's own lines."""
    held, holds = plain.copy(), np.array([name in ("article", "main") for name, *_ in regions])
    for i in range(len(regions) - 1, 0, -1):  # parents come first
        held[regions[i][1]] += held[i]
        holds[regions[i][1]] |= holds[i]
    depth, article = np.zeros(len(regions), int), np.full(len(regions), -1)
    for i, (name, parent, weak) in enumerate(regions):
        if parent >= 0:
            depth[i], article[i] = depth[parent], article[parent]
        share = held[i] / max(held[0], 1)
        titles = name == "header" and article[i] == depth[i]
        depth[i] += weak and not titles and share < NEARLY_ALL and not (holds[i] and share >= 0.5)
        if name in ("article", "main"):
            article[i] = depth[i]
    return depth, article


def chosen(page: Lines, smooth=smoothed) -> list[str]:
    """The texts of the page's content lines."""
    if not page.lines:
        return []
    n = len(page.regions)
    size = np.array([len(t) for t, *_ in page.lines], float)
    plain = np.array([max(0, len(t) - links) for t, links, *_ in page.lines], float)
    tags = np.array([n for *_, n, _ in page.lines], float)
    region = np.array([r for *_, r in page.lines])
    depth, article = weakness(page.regions, np.bincount(region, plain, n))
    ratio = smooth(plain / np.maximum(tags, 1)) * LESS ** depth[region]
    content = ratio >= min(ratio.std(), ratio.mean())
    held = np.bincount(region, size * content, n)
    kept = held * 2 >= np.maximum(np.bincount(region, size, n), 1)
    reached = (article >= 0) & (held > 0)
    if reached.any():
        least = article[reached].min()
        kept = (article == least) & ((depth == least) | kept)
    return [t for (t, *_, r) in page.lines if kept[r]]


def main_text(html: str | None) -> str:
    html = html or ""
    last = html.rfind("<")
    if last >= 0 and ">" not in html[last:] and re.match(r"<(?:[/!?a-zA-Z]|$)", html[last:last + 2]):
        html = html[:last]
    page = Lines()
    for at in range(0, len(html), PIECE):
        page.feed(html[at:at + PIECE])
    page.close()
    page.end_line()
    return "\n".join(chosen(page))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per row of ``pages``."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [main_text(h) for h in batch.column("html").to_pylist()]
        return pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                               names=["page_id", "url", "text", "n_chars"])

    return map_rows(pages.select("page_id", "url", "html"), "page_id long, url string, text string, n_chars long", kernel)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(documents(spark, sf_dir, "pages"))
