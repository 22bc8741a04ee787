"""Main text of HTML pages from standard-library parser events.

The parser's events become lines, one for each block of text, each with its text-to-tag ratio (characters
over tags met since the line before), less the share of its characters that are links.  Lines in elements that never
hold the article (menus, forms, scripts, ...) or under class names of adverts, comments and the like have ratio 0.
Ratios are smoothed with a Gaussian, two clusters of them set the threshold, and lines above it mark the content.

The content's regions: all outermost containers (article, main), where a page has any.  Else the innermost element
that holds most of the marked text and lines, with all of its lines; where only the page as a whole does, the runs
of marked lines, with what stands in the same elements or between them and isn't links, and the headings before.

Class names that an article may use too (header, side, tags, ...) decide nothing alone: under them a block goes if its
own ratio is below the threshold.  Headings and paragraphs go by an advert's or comment's name only.

Cases: null or empty html, or a page without text, gives an empty text; broken markup is parsed as far as
events go; every row has its result, repeated rows alike.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readlake.llm.common import small, table

SIGMA = 1.0
MOST, MANY = 0.75, 0.6  # shares of the marked text and of the marked lines that the content's element holds
BRIDGE = 3  # lines that may stand between two marked ones
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr br".split()
)
DROPPED = frozenset(
    "script style noscript template nav footer aside form iframe svg math button select textarea input object embed canvas audio video head title menu dialog".split()
)
#: What a head holds; other tags, and text, close one that is open.
HEAD = frozenset("base link meta noscript script style template title".split())
CONTAINERS = frozenset(("article", "main"))
#: Words of class and id names that mark what isn't the article.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead footer "
    "sidebar side aside widget comment comments disqus respond reply replies cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended recommendations toolbar pagination pager tags".split()
)
#: Of these, words that headings and paragraphs go by too, and words that articles use as well.
HARD = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion comment comments cookie cookies newsletter".split())
SOFT = frozenset("header masthead side tags widget banner related share sharing social respond reply replies toolbar notice notices alert".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words that mark a wrapper of the article, whatever else its name says.
WRAPPERS = frozenset("article content main post entry page wrapper container layout story body".split())
ROLES = frozenset("navigation banner complementary contentinfo search form alert alertdialog dialog menu menubar toolbar".split())
_WORDS = re.compile(r"[a-z]+")
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Elements that an opening tag of the key closes when they are the innermost block.
CLOSES = {
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"},
    "th": {"td", "th", "p"}, "option": {"option"},
}


class Lines(HTMLParser):
    """lines: [text, tags, container number or -1, dropped, region, characters in links, heading, under a soft name].

    A region is the number of the element around the line's own block, or -1.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[list] = []
        self.stack: list[tuple[str, bool, int, int, bool]] = []  # element, dropped, container, number of the block, under a soft name
        self.around: list[int] = []  # of each block, by number: that around it
        self.regions: list[int] = []  # of each block, by number: the region of its lines
        self.held: list[str] = []
        self.tags = 0
        self.containers = 0
        self.links = 0  # characters of the held text that stand in links

    def state(self) -> tuple[bool, int, int, bool]:
        return self.stack[-1][1:] if self.stack else (False, -1, -1, False)

    def flush(self) -> None:
        text = " ".join("".join(self.held).split())
        self.held.clear()
        if text:
            dropped, container, block, soft = self.state()
            heading = any(tag in HEADINGS for tag, *_ in self.stack[-4:])
            self.lines.append([text, self.tags, container, dropped, self.regions[block] if block >= 0 else -1, min(self.links, len(text)), heading, soft])
            self.tags = 0
        self.links = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        inline = tag in INLINE
        if not inline:
            self.flush()
        elif tag == "br":
            self.held.append(" ")
        self.tags += 1
        if tag == "body" or (self.stack and self.stack[-1][0] == "head" and tag not in HEAD):
            self.shut_head()
        if tag in VOID:
            return
        if not inline:
            shut = CLOSES.get(tag, {"p"})
            # inline elements left open inside the block that closes go with it
            depth = len(self.stack)
            while depth and (self.stack[depth - 1][0] in INLINE or self.stack[depth - 1][0] in shut):
                depth -= 1
                if self.stack[depth][0] in shut:
                    del self.stack[depth:]
        dropped, container, block, soft = self.state()
        inside = container >= 0
        names = {w.lower() for k, v in attrs if k in ("class", "id") and v for w in _NAMES.findall(v)}
        role = {w for k, v in attrs if k == "role" and v for w in _WORDS.findall(v.lower())}
        hidden = any(k == "hidden" or (k == "aria-hidden" and v == "true") for k, v in attrs)
        bad = tag in DROPPED or hidden or bool(role & ROLES) or (tag == "header" and not inside)
        if names & BOILERPLATE and (not names & WRAPPERS or names & {"comment", "comments", "ad", "ads", "related"}) and tag not in ("html", "body", "h1"):
            if tag == "p" or tag in HEADINGS:
                bad = bad or bool(names & HARD)
            elif inside and names & BOILERPLATE <= SOFT:
                soft = True
            else:
                bad = True
        if (tag in CONTAINERS or "main" in role) and not bad and not dropped and not inside:
            container = self.containers
            self.containers += 1
        if not inline:
            self.around.append(block)
            block = len(self.around) - 1
            self.regions.append(block if tag in ("html", "body") else self.around[block])
        self.stack.append((tag, dropped or bad, container, block, soft))

    def shut_head(self) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == "head":
                del self.stack[k:]
                return

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag not in INLINE:
            self.flush()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                return
            if tag in INLINE and self.stack[k][0] not in INLINE:
                return  # a stray end tag closes no block

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1][0] == "head" and data.strip():
            self.shut_head()
        self.held.append(data)
        if any(tag == "a" for tag, *_ in self.stack[-4:]):
            self.links += len(" ".join(data.split()))

    def unknown_decl(self, data: str) -> None:
        return None


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    reach = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for k, w in enumerate(kernel, i - reach):
            if 0 <= k < len(values):
                total, weight = total + w * values[k], weight + w
        out.append(total / weight)
    return out


def two_clusters(values: list[float]) -> float:
    """The threshold between two clusters of values."""
    low, high = min(values), max(values)
    for _ in range(50):
        cut = (low + high) / 2
        below, above = [v for v in values if v <= cut], [v for v in values if v > cut]
        if not below or not above:
            return cut
        new = (sum(below) / len(below), sum(above) / len(above))
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def chosen_region(parser: Lines, marked: list[bool]) -> list[bool]:
    """Whether each line is content, by the innermost element that holds MOST of the marked text and MANY of the marked lines."""
    size = len(parser.around)
    text, count = [0] * (size + 1), [0] * (size + 1)  # the last is the page
    for line, m in zip(parser.lines, marked, strict=True):
        if m:
            text[line[4]] += len(line[0])
            count[line[4]] += 1
    for k in range(size - 1, -1, -1):  # an element's number is less than those in it
        text[parser.around[k]] += text[k]
        count[parser.around[k]] += count[k]
    best = max((k for k in range(size) if text[k] >= MOST * text[-1] and count[k] >= MANY * count[-1]), default=-1)
    inside = [best < 0] * (size + 1)
    for k in range(size):
        inside[k] = k == best or inside[parser.around[k]]
    if best >= 0 and parser.regions[best] != best:  # not html or body
        return [inside[line[4]] for line in parser.lines]
    return runs(parser.lines, [m and inside[line[4]] for line, m in zip(parser.lines, marked, strict=True)])


def runs(lines: list[list], marked: list[bool]) -> list[bool]:
    """Marked lines, with those of their regions and between them that aren't links, and the headings right before."""
    plain = [not line[3] and 2 * line[5] < len(line[0]) for line in lines]
    regions = {line[4] for line, m in zip(lines, marked, strict=True) if m}
    content = [m or (p and line[4] in regions) for line, m, p in zip(lines, marked, plain, strict=True)]
    last = -1
    for k, c in enumerate(content):
        if c:
            if 0 <= last and k - last <= BRIDGE + 1:
                for between in range(last + 1, k):
                    content[between] = plain[between]
            last = k
    for k in range(len(lines) - 2, -1, -1):
        if lines[k][6] and content[k + 1] and plain[k]:
            content[k] = True
    return content


def main_text(html: str) -> list[str]:
    """The blocks of the page's main text, in order."""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    lines = parser.lines
    if not any(not line[3] for line in lines):
        return []
    own = [0.0 if line[3] else math.sqrt(len(line[0]) / max(1, line[1])) * (1 - line[5] / len(line[0])) for line in lines]
    ratios = smoothed(own)
    threshold = two_clusters(ratios)
    marked = [not line[3] and ratio >= threshold for line, ratio in zip(lines, ratios, strict=True)]
    boxed = [line[2] >= 0 and not line[3] for line in lines]
    inside = boxed if any(boxed) else chosen_region(parser, marked)
    return [line[0] for line, i, ratio in zip(lines, inside, own, strict=True) if i and not line[3] and not (line[7] and ratio < threshold)]


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches):
        for batch in small(batches):
            texts = ["\n\n".join(main_text(x)) if x else "" for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
