"""Main-text extraction from HTML (operator 10).

The standard library's parser streams start tags, end tags and texts.  They are
folded into *lines*, one for each block of text, which count their characters
and tags, wherever in the page they stand.  A line's text-to-tag ratio, in
logarithms, is smoothed along the page with a Gaussian window, and two-means
clustering of the smoothed ratios gives the threshold over which lines count as
content.

Clustering selects *regions*: a region is kept if lines over the threshold hold
at least half of its characters (if none does, the one that holds most of them),
and then as a whole, so its short headings and paragraphs stay.  Where a page
declares its content (``article`` or ``main``) these elements are the regions;
on other pages they are the innermost sections, divisions and cells, and a
heading right above a kept line is kept.

Elements are evidence only.  Lines inside navigation, headers, footers,
sidebars, forms, scripts, styles, adverts, notices and reader comments, told by
tag, role, class or id, and on pages that declare content the lines outside it,
have a ratio of nought.  They weigh on their neighbours and on the clusters, and
are not part of a region.  Within declared content a class or id tells only if
it is such a name as a whole or starts with an unmistakable one, and never on
headings and their wrappers.

Null and empty pages give an empty text; so do pages without a line that can be
content.  Broken markup is read as the parser reads it: an unclosed block ends
at the next block, an unclosed excluded element at its parent's end or, unless it
is one whose articles are not the page's (comments, sidebars, footers), at an
``article`` or ``main``.  White space inside a
block becomes one space; ``br`` counts as white space.  Work is linear in the
page, however deep or broken its markup.  Rows that repeat are repeated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

RESULT = "page_id long, url string, text string, n_chars long"

#: Elements that start a line of their own.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
DECLARED = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("article body div main section td".split())
#: Elements whose text is not part of the content.
SKIPPED = frozenset("aside button dialog footer form head header iframe input label menu nav noscript object option script select style svg template textarea title".split())
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Parts of a class or id, split at anything but letters and digits.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments consent cookie cookies disqus footer header "
    "masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted recommended related search share sharing "
    "sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Names that tell as the first part of a class or id inside declared content too.
STRONG = frozenset("ad ads advert adverts advertisement advertising comment comments cookie cookies disqus newsletter sidebar sponsored".split())
#: Names that inside declared content are as likely part of the article.
WEAK = frozenset("banner byline header masthead related search share widget".split())
#: Elements and names whose articles are not the page's: replies, teasers.
FIRM = frozenset("aside comment comments disqus footer form recommended related sidebar".split())
SPLIT = re.compile(r"[^a-z0-9]+")
#: Width of the Gaussian window, in lines.
SIGMA = 1.0

#: text, tags before and in it, region, heading, may be content
Line = tuple[str, int, int, bool, bool]


class Lines(HTMLParser):
    """Folds parser events into lines."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.texts: list[str] = []
        self.skipped: list[str] = []  # texts in excluded elements
        self.tags = 0
        self.open: list[str] = []
        self.depths: dict[str, list[int]] = {}  # of the open elements of each name
        self.skip_at: list[tuple[int, str]] = []  # depths at which an excluded element opened, and why
        self.declared_at: list[int] = []
        self.containers: list[tuple[int, int]] = []  # depth, number
        self.numbered = 0
        self.declares = False
        self.declared_number = 0
        self.heading = False

    def flush(self) -> None:
        of = -self.declared_number if self.declared_at else self.containers[-1][1] if self.containers else 0
        for texts, may in ((self.texts, True), (self.skipped, False)):
            if texts:
                text = " ".join("".join(texts).split())
                if text:
                    self.lines.append((text, self.tags, of, self.heading, may))
                    self.tags = 0
                texts.clear()
        self.heading = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br":
            (self.skipped if self.skip_at else self.texts).append(" ")
            return
        if tag in BLOCKS:
            self.flush()
            if tag in HEADINGS:
                self.heading = True
            if tag == "p" and "p" in self.open[-4:]:
                self.close_tag("p")
        if tag in VOID:
            return
        marked = self.marked(tag, attrs) if attrs else None
        skips = tag in SKIPPED and not (tag in ("header", "label") and self.declared_at) or marked is not None
        self.open.append(tag)
        depth = len(self.open)
        self.depths.setdefault(tag, []).append(depth)
        if tag in CONTAINERS:
            self.numbered += 1
            self.containers.append((depth, self.numbered))
        if tag in DECLARED and marked is None:
            if not self.declared_at and all(name not in FIRM for _, name in self.skip_at):
                self.skip_at.clear()  # never closed: a menu, an advert
            if not self.skip_at:
                if not self.declared_at:
                    self.declared_number = self.numbered
                self.declared_at.append(depth)
                self.declares = True
        elif skips:
            self.skip_at.append((depth, tag if marked is None else marked))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def marked(self, tag: str, attrs: list[tuple[str, str | None]]) -> str | None:
        """The name by which an element's attributes exclude it, a firm one before others."""
        found = None
        for name, value in attrs:
            if name in ("class", "id"):
                names = self.names(tag, value.lower()) if value else ()
                found = next((n for n in names if n in FIRM), found or next(iter(names), None))
            elif name == "role":
                if value and value.strip().lower() in ROLES:
                    found = found or value.strip().lower()
            elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                found = found or "hidden"
        return found

    def names(self, tag: str, value: str) -> list[str]:
        if not self.declared_at:
            return [x for x in SPLIT.split(value) if x in MARKS]
        if tag in HEADINGS or tag in ("header", "hgroup"):
            return []
        out = [w for w in value.split() if w in MARKS and w not in WEAK]
        return out + [first for w in value.split() if (first := next(filter(None, SPLIT.split(w)), "")) in STRONG]

    def close_tag(self, tag: str) -> None:
        own = self.depths.get(tag)
        if not own:
            return
        depth = own[-1]
        if self.declared_at and self.declared_at[-1] > depth and tag not in DECLARED and tag not in ("body", "html"):
            return  # a stray end tag inside the content closes nothing outside
        while len(self.open) >= depth:
            self.depths[self.open.pop()].pop()
        while self.skip_at and self.skip_at[-1][0] >= depth:
            self.skip_at.pop()
        while self.declared_at and self.declared_at[-1] >= depth:
            self.declared_at.pop()
        while self.containers and self.containers[-1][0] >= depth:
            self.containers.pop()

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        self.close_tag(tag)

    def handle_data(self, data: str) -> None:
        if not self.skip_at:
            self.texts.append(data)
        elif self.open[-1] not in ("script", "style"):
            self.skipped.append(data)

    def finish(self, html: str) -> list[Line]:
        self.feed(html)
        self.close()
        self.flush()
        return self.lines


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian-weighted mean along the lines; the window is cut at the ends.  No width: the ratios themselves."""
    if not sigma:
        return ratios
    reach = max(1, round(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    n = len(ratios)
    top = np.convolve(ratios, kernel)[reach : reach + n]
    return top / np.convolve(np.ones(n), kernel)[reach : reach + n]


def threshold(values: np.ndarray) -> float:
    """Midpoint of two clusters (two-means from the extremes)."""
    low, high = float(values.min()), float(values.max())
    for _ in range(20):
        cut = (low + high) / 2
        under = values < cut
        if under.all() or not under.any():
            return low
        new = float(values[under].mean()), float(values[~under].mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def content(lines: list[Line], declares: bool, sigma: float = SIGMA) -> list[bool]:
    """Which lines belong to the regions that clustering selects."""
    may = [x[4] and (x[2] < 0 or not declares) for x in lines]
    ratios = np.array([len(x[0]) / max(1, x[1]) if ok else 0.0 for x, ok in zip(lines, may, strict=True)])
    even = smoothed(np.log1p(ratios), sigma)
    over = even >= threshold(even)
    size: dict[int, int] = {}
    held: dict[int, int] = {}
    for x, ok, hit in zip(lines, may, over.tolist(), strict=True):
        if ok:
            size[x[2]] = size.get(x[2], 0) + len(x[0])
            held[x[2]] = held.get(x[2], 0) + (len(x[0]) if hit else 0)
    regions = {r for r in size if 2 * held[r] >= size[r]}
    if not regions and size:
        regions = {max(size, key=lambda r: (held[r], size[r], -abs(r)))}
    keep = [ok and x[2] in regions for x, ok in zip(lines, may, strict=True)]
    if not declares:
        for i in range(len(lines) - 2, -1, -1):
            keep[i] = keep[i] or (lines[i][3] and may[i] and keep[i + 1])
    return keep


def main_text(html: str | None, sigma: float = SIGMA) -> str:
    if not html:
        return ""
    parser = Lines()
    lines = parser.finish(html)
    if not lines:
        return ""
    return "\n".join(x[0] for x, k in zip(lines, content(lines, parser.declares, sigma), strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            texts = [main_text(h) for h in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(run, RESULT)
