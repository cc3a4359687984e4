"""Operator 8: main text of HTML pages by text-to-tag ratio.

The standard library's parser streams its events into lines, one for each block of a page. A line's ratio is
its text's length against its tags; the ratios are smoothed with a Gaussian over neighbouring lines and parted
in two clusters by a threshold. The lines above it are the content; the region is the smallest box of the page
that holds most of their text, and what lies around it is dropped, whatever it is called. Inside the region short lines
belong to the content too: those beside marked ones, those between the first and the last marked one, and headings.
Structure trims: menus, site headers, footers, sidebars, notices, adverts, forms and comments are told by
their tags and by whole names in class, id and role, and are no lines of the region. Inside an article a name can be the
article's own word (a section "discussion", a paragraph "lead share"): there a named paragraph, heading or quotation, and a
section named by its id alone, is in doubt, and its smoothed ratio decides: it goes if that is below the threshold, or if it is mostly links.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm.common import batch, slices, table

#: HTML elements that begin a line of their own.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: HTML elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text isn't an article's.
APART = frozenset("nav footer aside form script style noscript noembed template head title button select textarea iframe svg canvas object audio video dialog menu search datalist".split())
#: Names in class, id and role attributes of such parts of a page.
APART_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup social share sharing "
    "comment comments commentlist reply replies respond discussion disqus related recommended recommendations teaser widget toolbar pagination pager masthead login "
    "complementary contentinfo search skip".split()
)
#: Those of them that name readers' comments, whose prose is as dense as an article's.
COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond disqus".split())
#: The same for articles, which hold what they name, if they aren't lists of others.
ARTICLE_WORDS = frozenset("comment comments teaser related ad".split())
#: The same for site headers, which inside an article are its own heading.
HEADER_WORDS = frozenset("header heading topbar".split())
#: What such names are joined with (site-footer, cookie_bar) without meaning anything else.
PLACE_WORDS = frozenset("site page main top bottom left right side bar box block list wrap wrapper container area section inner outer global primary secondary item items content link links button form icon icons label text".split())
CONTENT = frozenset(["article", "main"])
BOXES = frozenset(["body", "div", "section", "td", "th", "table", "center", "article", "main"])
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
#: Elements that hold text and no parts of a page.
TEXTS = HEADINGS | {"p", "blockquote", "pre", "figure", "figcaption"}
#: What a line is but one of the region: in a part with lines of its own, in one inside a line, in doubt.
APART_LINES, APART_INLINE, DOUBT = 1, 2, 3
_WORD = re.compile(r"[a-z0-9]+")


def names(value: str, known: frozenset[str]) -> bool:
    """Whether one of the names in an attribute is known as a whole: ``ad``, ``cookie-notice``, ``site-footer``; not ``ad-hoc``."""
    for name in value.lower().split():
        words = _WORD.findall(name)
        if any(w in known for w in words) and all(w in known or w in PLACE_WORDS or w.isdigit() for w in words):
            return True
    return False


@dataclass
class Line:
    """One block of text: its tags, characters inside links, whether it is apart or in doubt, number of its box, whether a heading."""

    text: str
    tags: int
    linked: int
    apart: int
    box: int
    heading: bool


class Lines(HTMLParser):
    """Lines of a page, and the tag and parent of each of its boxes; box 0 is the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        # Tag, apart (inside a line its text goes on behind the part), inside an article or main, box.
        self.open: list[tuple[str, int, bool, int]] = [("", 0, False, 0)]
        self.boxes: list[tuple[str, int]] = [("", -1)]
        self.parts: list[str] = []
        self.tags = self.links = self.linked = 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                tag, apart, _, box = self.open[-1]
                heading = tag in HEADINGS or any(o[0] in HEADINGS for o in self.open[-4:-1])
                self.lines.append(Line(text, max(1, self.tags), self.linked, apart, box, heading))
            self.parts = []
        self.tags = self.linked = 0  # tags between two blocks are neither's

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
            self._imply_end(tag)
        elif tag == "br":
            self.parts.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        if tag == "a":
            self.links += 1
        _, apart, inside, box = self.open[-1]
        if apart in (0, DOUBT):
            own = self._apart(tag, attrs, inside)
            apart = own if own == DOUBT else (APART_LINES if tag in BLOCKS else APART_INLINE) if own else apart
        if tag in BOXES:
            self.boxes.append((tag, box))
            box = len(self.boxes) - 1
        self.open.append((tag, apart, inside or tag in CONTENT, box))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _apart(self, tag, attrs, inside: bool) -> int:
        """Whether a tag begins a part of the page that isn't the article's: 0, 1 or DOUBT."""
        if tag in APART or tag == "header" and not inside:
            return 1
        named, number, unseen = "", "", False
        for name, value in attrs:
            if name in ("class", "role"):
                named += f" {value or ''}"
            elif name == "id":
                number = value or ""
            elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value or ""):
                return 1
            elif name == "aria-hidden" and value == "true":
                unseen = True
        if tag in CONTENT or tag in ("body", "html"):
            return int(unseen or tag == "article" and names(f"{named} {number}", ARTICLE_WORDS))
        if inside and tag in TEXTS:
            return DOUBT if unseen or names(f"{named} {number}", APART_WORDS) else 0
        if unseen or names(named, APART_WORDS) or not inside and names(f"{named} {number}", HEADER_WORDS):
            return 1
        if names(number, APART_WORDS):
            return DOUBT if inside and tag in ("section", "div") and not names(number, COMMENT_WORDS) else 1
        return 0

    def _imply_end(self, tag: str) -> None:
        """A block ends an open paragraph, an item the item before it."""
        ends = ("p", tag) if tag in ("li", "dt", "dd", "tr", "td", "th", "option") else ("p",)
        for k in range(len(self.open) - 1, 0, -1):
            now = self.open[k][0]
            if now in ends:
                del self.open[k:]
            elif now in BLOCKS or now in APART:
                return

    def handle_endtag(self, tag):
        self.tags += 1
        if tag == "a" and self.links:
            self.links -= 1
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                if tag in BLOCKS:
                    self.flush()
                del self.open[k:]
                return
            if tag not in BLOCKS and self.open[k][0] in BLOCKS:
                return  # an inline end tag doesn't close a block

    def handle_data(self, data):
        if self.open[-1][1] != APART_INLINE:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def smoothed(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing whose weights sum to 1 at the ends too."""
    reach = int(3 * sigma)
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma**2))
    width = len(kernel) - 1 - reach
    return np.convolve(ratios, kernel)[reach : reach + len(ratios)] / np.convolve(np.ones(len(ratios)), kernel)[width : width + len(ratios)]


def threshold(values: np.ndarray, rounds: int = 20) -> float:
    """The point between two clusters: halfway between their means, until it stays."""
    cut = float(values.mean())
    for _ in range(rounds):
        above, below = values[values >= cut], values[values < cut]
        new = (float(above.mean()) + float(below.mean())) / 2 if len(below) else cut
        if new == cut:
            break
        cut = new
    return cut


def region(lines: list[Line], boxes: list[tuple[str, int]], marked: np.ndarray, share: float = 0.8) -> list[bool]:
    """Which lines are content: see the module's docstring. ``share``: of the marked text that the region's box holds.

    Further articles of a page are regions of their own if the first is one, unless most of their text is links.
    """
    mass, direct = np.zeros(len(boxes)), np.zeros(len(boxes), bool)
    for line, m in zip(lines, marked.tolist()):
        if m:
            mass[line.box] += len(line.text)
            direct[line.box] = True
    for b in range(len(boxes) - 1, 0, -1):  # a box follows its parent
        mass[boxes[b][1]] += mass[b]
    if not mass[0]:
        return [False] * len(lines)
    root = max(b for b in range(len(boxes)) if mass[b] >= share * mass[0])
    whole = np.zeros(len(boxes), int)  # the article or main that a box lies in, or the region
    for b, (tag, parent) in enumerate(boxes):
        whole[b] = whole[parent] if b and whole[parent] else b if tag in CONTENT else 0
    chosen: set[int] = set()
    if whole[root]:
        text, linked = np.zeros(len(boxes)), np.zeros(len(boxes))
        for line in lines:
            text[whole[line.box]] += len(line.text)
            linked[whole[line.box]] += line.linked
        first = int(whole[root])
        chosen = {first} | {int(b) for b in set(whole.tolist()) - {0} if boxes[b][0] == boxes[first][0] and 2 * linked[b] < text[b]}
        return [int(whole[line.box]) in chosen for line in lines]
    inside = np.zeros(len(boxes), bool)
    for b, (_, parent) in enumerate(boxes):
        inside[b] = b == root or b > 0 and inside[parent]
    titled = {line.box for line in lines if line.heading}
    at = [k for k, (line, m) in enumerate(zip(lines, marked.tolist())) if m and inside[line.box]]
    kept = [bool(inside[line.box]) and (at[0] <= k <= at[-1] or bool(direct[line.box]) or line.box in titled) for k, line in enumerate(lines)]
    k = kept.index(True)
    while k and lines[k - 1].heading:  # a title in a box of its own
        k -= 1
        kept[k] = True
    return kept


def dense(lines: list[Line], marked: np.ndarray) -> list[bool]:
    """Which lines stay: all that aren't in doubt, and of those the marked ones that aren't mostly links; a heading goes with the line below it."""
    stay = [True] * len(lines)
    for k in range(len(lines) - 1, -1, -1):
        if lines[k].apart == DOUBT:
            below = lines[k].heading and k + 1 < len(lines)
            stay[k] = 2 * lines[k].linked <= len(lines[k].text) and bool(stay[k + 1] and (marked[k + 1] or marked[k]) if below else marked[k])
    return stay


def main_text(html: str, cut=threshold) -> str:
    """Blocks of the main text joined by an empty line; empty where a page has none. ``cut`` parts the smoothed ratios."""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    lines = [x for x in parser.lines if x.apart in (0, DOUBT)]
    if not lines:
        return ""
    ratios = smoothed(np.array([len(x.text) / x.tags for x in lines]))
    marked = ratios >= cut(ratios)
    stay = dense(lines, marked)
    lines, marked = [x for x, s in zip(lines, stay) if s], marked[np.array(stay)]
    return "\n\n".join(x.text for x, kept in zip(lines, region(lines, parser.boxes, marked)) if kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of each row's html; null html counts as empty: empty text.

    Every row has one row, repeated ids and null urls too; other columns of ``pages`` are not read. No shuffle.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [main_text(h) for h in b.column("html").to_pylist()]
            yield batch(schema, page_id=b.column("page_id"), url=b.column("url"), text=texts, n_chars=[len(t) for t in texts])

    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page; see ``extract`` for its cases."""
    return extract(table(spark, sf_dir, "pages"))
