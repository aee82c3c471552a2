"""Main-text extraction: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The standard library's parser streams events; each block-level boundary ends a line, whose ratio is its characters
outside of links over its tags. Lines in containers that hold no article text by element or role, and reader comments,
are out. All else is a prior, a factor on the ratio: class and id words make a container doubtful, an article or main
element makes what stands outside of it unlikely, as long as it holds a fair share of the page's text.
Ratios are smoothed inside of their container. What is content then is up to the threshold: an article, or a run of
neighbouring lines of one container, is one if its smoothed peak reaches it, and a cluster of lines that are nothing but
links leaves it where the ratio falls below. A region is kept whole otherwise, short paragraphs included.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA, RADIUS, THRESHOLD, CHUNK = 1.0, 3, 0.5, 200
#: Factors on ratios: for each doubtful container around a line, and outside of the article. The share of a page's text that
#: articles hold for that, and the share of the largest article that another one has to hold.
DOUBTFUL, OUTSIDE, ENOUGH, ANOTHER = 0.02, 0.02, 0.25, 0.1
_KERNEL = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)
# fixed values: element names of HTML
BLOCKS = frozenset("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("aside button canvas datalist dialog footer form head iframe menu nav noscript object script select style svg template textarea title".split())
MAIN = frozenset(("article", "main"))
#: Elements that the next of their kind, or the end of their parent, closes.
LOOSE = frozenset("dd dt li option p td th tr".split())
_BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|byline|comments?|consent|cookies?|disqus|footer|gdpr|header|login|masthead|menu|modal|"
    r"nav|navbar|navigation|newsletter|notice|notification|pagination|popup|promo\w*|related|replies|search|share|sharing|sidebar|signup|"
    r"social|sponsor\w*|subscribe|toolbar|widget)(?=$|[\s_-])", re.I
)
_COMMENTS = re.compile(r"(?:^|\s|(?<!has)(?<!with)(?<!no)(?<!without)[_-])(?:comments?|disqus|replies)(?=$|[\s_-])", re.I)
#: Words that inside an article name its own head.
_HEAD = re.compile(r"(?:^|(?<=[\s_-]))header(?=$|[\s_-])", re.I)
#: A line that closes a page.
_RIGHTS = re.compile(r"(?:\u00a9|\(c\)|copyright\b)", re.I)
#: A tag that the end of the page cuts off.
_UNFINISHED = re.compile(r"<[/!?A-Za-z][^<>]*$")
_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())


class Line(NamedTuple):
    text: str
    tags: int
    linked: int  # characters inside of links
    region: int | None  # None: not article text; 0: in no article; n: in the n-th article or main
    doubts: int  # doubtful containers around it


class Lines(HTMLParser):
    """The lines of a page in order. An article in a main element is a region of its own, one in an article isn't."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int | None, int]] = []
        self.lines: list[Line] = []
        self.text: list[str] = []
        self.regions: list[tuple[str, int]] = [("", 0)]  # element, and the region around it
        self.tags = self.linked = 0
        self.in_link = False

    @property
    def region(self) -> int | None:
        return self.stack[-1][1] if self.stack else 0

    @property
    def doubts(self) -> int:
        return self.stack[-1][2] if self.stack else 0

    def flush(self) -> None:
        if text := " ".join("".join(self.text).split()):
            self.lines.append(Line(text, self.tags, self.linked, self.region, self.doubts))
            self.tags = 0
        self.text, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS or tag in HIDDEN:
            self.flush()
            self.in_link = False
        self.tags += 1
        if tag == "a":
            self.in_link = True
        if tag in VOID:
            return
        if tag in LOOSE and self.stack and self.stack[-1][0] == tag:
            self.stack.pop()
        region, doubts = self.region, self.doubts
        if attrs and region is not None and tag not in ("html", "body"):
            known = dict(attrs)
            named = f"{known.get('class') or ''} {known.get('id') or ''}"
            if _COMMENTS.search(named) or (known.get("role") or "").lower() in _ROLES or "hidden" in known or known.get("aria-hidden") == "true" or "display:none" in (known.get("style") or "").replace(" ", ""):
                region = None
            elif tag not in MAIN and _BOILERPLATE.search(_HEAD.sub("", named) if region else named):
                doubts += 1
        if tag in HIDDEN or tag == "header" and region == 0:
            region = None
        elif tag in MAIN and region is not None and (region == 0 or tag == "article" and self.regions[region][0] == "main"):
            self.regions.append((tag, region))
            region = len(self.regions) - 1
        if tag in BLOCKS or tag in HIDDEN or (region, doubts) != (self.region, self.doubts):
            self.stack.append((tag, region, doubts))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS or tag in HIDDEN:
            self.flush()
            self.in_link = False
        elif tag == "a":
            self.in_link = False
        self.tags += 1
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return
            if tag in LOOSE and self.stack[i][0] not in LOOSE:
                return

    def handle_data(self, data: str) -> None:
        self.text.append(data)
        if self.in_link:
            self.linked += sum(map(len, data.split()))


def _likely(page: Lines) -> set[int]:
    """The regions that should hold the article: articles in main elements, else mains, else articles; none, if they hold
    too little of the page's text."""
    mass = [0] * len(page.regions)
    for line in page.lines:
        if line.region is not None and not line.doubts:
            mass[line.region] += max(0, len(line.text) - line.linked)
    kinds = [[i for i, (tag, around) in enumerate(page.regions) if i and mass[i] and (tag, around > 0) == kind] for kind in (("article", True), ("main", False), ("article", False))]
    for found in kinds:
        if found and sum(mass[i] for i in found) >= ENOUGH * sum(mass):
            return {i for i in found if mass[i] >= ANOTHER * max(mass[i] for i in found)}
    return set()


def scores(page: Lines) -> tuple[np.ndarray, list[list[int]]]:
    """The smoothed ratio of each line times its priors, and the groups: lines of one article, or neighbours, in one container."""
    lines, likely = page.lines, _likely(page)
    ratio = np.array([max(0, len(x.text) - x.linked) / max(1, x.tags) if x.region is not None else 0.0 for x in lines])
    if not ratio.any():  # nothing but links
        ratio = np.array([len(x.text) / max(1, x.tags) if x.region is not None else 0.0 for x in lines])
    prior = np.array([DOUBTFUL**x.doubts * (1.0 if not likely or x.region in likely else OUTSIDE) for x in lines])
    names = [(x.region, x.doubts) for x in lines]
    run = np.cumsum([0, *(a != b for a, b in zip(names, names[1:]))])
    groups: dict[tuple, list[int]] = {}
    for i, (x, r) in enumerate(zip(lines, run)):
        if x.region is not None:
            groups.setdefault((x.region, x.doubts) if x.region else (0, int(r)), []).append(i)
    smooth = np.zeros(len(lines))
    for at in groups.values():
        weight = np.convolve(np.ones(len(at)), _KERNEL)[RADIUS:-RADIUS]
        smooth[at] = np.convolve((ratio * prior)[at], _KERNEL)[RADIUS:-RADIUS] / weight
    return smooth, list(groups.values())


def main_text(html: str | None) -> str:
    """The kept lines in page order, joined by one space; empty for null or empty pages and pages without content."""
    page = Lines()
    page.feed(_UNFINISHED.sub("", html or ""))
    page.close()
    page.flush()
    lines = page.lines
    if not lines:
        return ""
    smooth, groups = scores(page)
    least = THRESHOLD * smooth.std() if len(smooth) > 1 else 0.0
    only_link = [x.linked > 0 and x.linked >= sum(map(len, x.text.split())) for x in lines]
    keep = np.zeros(len(lines), bool)
    for at in groups:
        if smooth[at].max() < least:
            continue
        if not lines[at[0]].region:  # a run outside of articles: from its first to its last line of content
            content = [i for i in at if smooth[i] >= least and not only_link[i] and not _RIGHTS.match(lines[i].text)] or [i for i in at if smooth[i] >= least]
            at = [i for i in at if content[0] <= i <= content[-1]]
        keep[at] = True
        start = 0
        while start < len(at):  # clusters of links
            end = start
            while end < len(at) and only_link[at[end]] and at[end] == at[start] + end - start:
                end += 1
            if end > start and smooth[at[start:end]].min() < least:
                keep[at[start:end]] = False
            start = max(end, start + 1)
    return " ".join(x.text for x, k in zip(lines, keep) if k)


def extract(pages: DataFrame) -> DataFrame:
    """pages to (page_id, url, text), a row for each row of the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array([main_text(h.as_py()) for h in part.column("html")], pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string")


def op7_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))
