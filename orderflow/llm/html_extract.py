"""Main text of web pages: parser events, text-to-tag ratios, smoothing, clustering.

The standard library's parser turns a page into lines: what stands between two block tags, with the number of tags met on
the way there and the element it stands in. The logarithm of each line's letters a tag is smoothed along the page with a
Gaussian window, and two clusters of the smoothed ratios are parted by a threshold. Lines above it speak with their length for
the elements around them, lines below it against them: the innermost element with nearly the best balance is the
content region. Of its lines those above the threshold stay; of the others paragraphs, headings, list items and cells, unless
they are links and nothing else.

Names of elements and classes help: what calls itself a menu, an advert and so on counts as a line without letters, and
does not stay; an element that calls itself an article is the region if its balance is half of the best, and stays whole else. Within an
article a name that only holds such a word (``login-guide``, ``related-work``) decides nothing: the element goes if its lines of
content do not outweigh its others, or if half of it is links. The ids of headings, paragraphs and the like never count.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.llm._shared import table, text_slices

NEVER = 1 << 62
SIGMA = 1.0  # lines
SHARE = 0.9  # of the best balance; the innermost element that has it is the region
NEARLY = 0.5  # of the best balance, for an element that calls itself an article

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre"
    " search section select summary table tbody td template textarea tfoot th thead title tr ul".split()
)
#: Elements whose content is not shown as text, or is a form's.
UNSHOWN = frozenset(
    "audio button canvas datalist embed fieldset form frameset head iframe input map noscript object script select style svg template"
    " textarea title video".split()
)
DROPPED = frozenset("aside dialog footer menu nav search".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of a class or id that mark what is no content.
MARKS = frozenset(
    "ad ads adbox adslot advert advertisement adverts advertising banner billboard breadcrumb breadcrumbs byline comment comments"
    " commentlist consent cookie cookies copyright discussion disqus dropdown footer gdpr header login masthead menu modal nav navbar"
    " navigation newsletter notice notices notification outbrain paywall popup promo promoted promotion reactions recommended related replies"
    " reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola teaser toolbar tooltip"
    " topbar widget".split()
)
#: Words that may stand beside those in a name that means nothing else.
BESIDE = frozenset(
    "area bar block bottom box btn button buttons card center cell column container cta fixed foot global grid group head inline inner item"
    " items left link links list lists outer page panel posts right row section section site slot small sticky the top unit user wrap wrapper zone".split()
)
CONTENT = frozenset("article body content main post story text".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_PARAGRAPH_ENDS = BLOCKS - {"option", "optgroup", "legend", "caption", "summary", "tbody", "td", "tfoot", "th", "thead", "tr", "title"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold running text.
TEXTUAL = HEADINGS | frozenset("blockquote caption dd dt figcaption li p pre summary td th".split())
#: Elements that may be the region.
REGIONS = BLOCKS - TEXTUAL | {"td"}


class _Element:
    __slots__ = ("tag", "parent", "unshown", "named", "doubtful", "in_article", "depth", "links", "balance", "first", "inside")

    def __init__(self, tag: str, parent: _Element | None, unshown: bool, named: bool, doubtful: bool = False):
        self.tag, self.parent, self.unshown, self.named = tag, parent, unshown, named
        self.doubtful = self if doubtful else parent.doubtful if parent else None  # the innermost element whose name decides nothing
        self.in_article = tag in ("article", "main") or bool(parent and parent.in_article)
        self.depth = parent.depth + 1 if parent else 0
        self.links = tag == "a" or bool(parent and parent.links)
        self.balance, self.first, self.inside = 0, NEVER, False


@dataclass
class Line:
    """What stands between two block tags: its text, the tags met on the way there, its element, and how much of it is links."""

    text: str
    tags: int
    element: _Element
    linked: int


class _Lines(HTMLParser):
    """Collects ``lines`` of text that is shown, and ``elements``, outer ones first."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.at = _Element("", None, False, False)
        self.elements = [self.at]
        self.open: Counter[str] = Counter()  # around the place that is read
        self.lines: list[Line] = []
        self.pieces: list[str] = []
        self.tags = self.linked = 0

    def flush(self) -> None:
        text = " ".join("".join(self.pieces).split())
        self.pieces = []
        if text:
            self.lines.append(Line(text, self.tags, self.at, self.linked))
            self.tags = 0
        self.linked = 0

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        elif tag == "br":
            self.pieces.append(" ")
        if tag in VOID:
            return
        if tag in _PARAGRAPH_ENDS:
            self._close_implied("p")
        if tag in ("li", "dd", "dt", "tr", "td", "th", "option"):
            self._close_implied(tag)
        named, doubtful = self._is_named(tag, attrs)
        self.at = _Element(tag, self.at, self.at.unshown or tag in UNSHOWN, self.at.named or named, doubtful)
        self.elements.append(self.at)
        self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close_implied(self, tag: str) -> None:
        """Close an open element of this tag, unless a block lies between."""
        e = self.at
        while self.open[tag] and e.tag != tag and e.tag not in BLOCKS:
            e = e.parent
        if e.tag == tag:
            self._leave(e)

    def _leave(self, element: _Element) -> None:
        """Close an open element and all within it."""
        while self.at is not element.parent:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        if self.open[tag]:
            e = self.at
            while e.tag != tag:
                e = e.parent
            self._leave(e)

    def handle_data(self, data):
        if self.at.unshown:
            return
        self.pieces.append(data)
        if self.at.links:
            self.linked += len(data.strip())

    def parse_html_declaration(self, i):
        """Whatever begins with ``<!`` and is no comment ends at the next ``>``, or with the page; as in browsers."""
        end = self.rawdata.find(">", i)
        return len(self.rawdata) if end < 0 else end + 1

    parse_pi = parse_bogus_comment = parse_html_declaration

    def parse_comment(self, i, report=1):
        """A comment that does not end takes the rest of the page; ``<!-->`` is a whole one."""
        if self.rawdata.startswith((">", "->"), i + 4):
            return self.rawdata.index(">", i) + 1
        ends = [k for k in (self.rawdata.find(e, i + 4) for e in ("-->", "--!>")) if k >= 0]
        return self.rawdata.index(">", min(ends)) + 1 if ends else len(self.rawdata)

    def parse_endtag(self, i):
        """One that the page cuts off is no text, and one without a name is a comment."""
        data, end = self.rawdata, self.rawdata.find(">", i)
        if end < 0 and len(data) > i + 2:
            return len(data)
        named = data[i + 2 : i + 3].isalpha() or self.cdata_elem
        return super().parse_endtag(i) if named or end < 0 else end + 1

    def close(self):
        """A tag that is cut off by the end of the page is no text; one with a quote that never ends, up to its ``>``."""
        while re.match("</?[A-Za-z]", self.rawdata):
            rest = self.rawdata.partition(">")[2]
            self.rawdata = ""
            self.feed(rest)
        super().close()
        self.flush()

    def _is_named(self, tag: str, attrs) -> tuple[bool, bool]:
        """Whether an element calls itself something that is no content, and whether it may mean something else."""
        if tag in DROPPED or tag == "header" and not self.at.in_article:
            return True, False
        if tag in ("html", "body", "main", "article"):
            return False, False
        doubtful = False
        for name, value in attrs:
            if name == "role" and (value or "").lower() in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
                return True, False
            if name == "class" and value or name == "id" and value and tag not in TEXTUAL:
                for one in value.split() if self.at.in_article else [value]:
                    words = {w.lower() for w in _WORD.findall(one)}
                    if words & MARKS and not words & CONTENT or words & {"comment", "comments", "sidebar", "advert", "cookie"}:
                        if not self.at.in_article or words <= MARKS | BESIDE | CONTENT:
                            return True, False
                        doubtful = True
        return False, doubtful and tag not in TEXTUAL


def _block(e: _Element) -> _Element:
    """The innermost block around a place."""
    while e.tag not in BLOCKS and e.parent is not None:
        e = e.parent
    return e


def _ratios(lines: list[Line]) -> np.ndarray:
    """Logarithm of letters a tag, of each line; what is named as no content counts as if it had no letters."""
    return np.log1p([0 if x.element.named else len(x.text) / max(1, x.tags) for x in lines])


def _smoothed(ratios: np.ndarray) -> np.ndarray:
    reach = int(3 * SIGMA)
    window = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    weight = np.convolve(np.ones(len(ratios)), window, "full")[reach : reach + len(ratios)]
    return np.convolve(ratios, window, "full")[reach : reach + len(ratios)] / weight


def _threshold(values: np.ndarray) -> float:
    """Between the means of two clusters, found by the usual alternation; the lowest value if all are alike."""
    low, high = float(values.min()), float(values.max())
    for _ in range(20):
        cut = (low + high) / 2
        upper = values >= cut
        if upper.all() or not upper.any():
            return float(values.min())
        now = float(values[~upper].mean()), float(values[upper].mean())
        if now == (low, high):
            break
        low, high = now
    return (low + high) / 2


def _region(parser: _Lines, content: np.ndarray) -> _Element:
    """The innermost element, and of these the first, whose lines of content outweigh its other lines about as much as they do anywhere.

    An ``article``, or else a ``main``, is preferred if it has at least half of that balance.
    """
    for i, (line, good) in enumerate(zip(parser.lines, content, strict=True)):
        e, n = line.element, len(line.text)
        e.first, e.balance = min(e.first, i), e.balance + (n if good else -n)
    for e in reversed(parser.elements[1:]):
        e.parent.first = min(e.parent.first, e.first)
        e.parent.balance += e.balance
    root = parser.elements[0]
    able = [e for e in parser.elements if e is root or e.first < NEVER and not e.named and e.tag in REGIONS]
    most = max(e.balance for e in able)
    for tag in ("article", "main"):
        named = [e for e in able if e.tag == tag and e.balance >= NEARLY * max(most, 1)]
        if named:
            return max(named, key=lambda e: (e.balance, -e.first))
    return max((e for e in able if e.balance >= SHARE * most or e is root), key=lambda e: e.depth)


def _decide(lines: list[Line], content: np.ndarray) -> np.ndarray:
    """Names elements whose names decide nothing by what is in them, and tells which lines go with them."""
    held: dict[_Element, list[int]] = {}
    for i, x in enumerate(lines):
        e = x.element.doubtful
        while e is not None:
            held.setdefault(e, []).append(i)
            e = e.parent.doubtful if e.parent else None
    gone = np.zeros(len(lines), bool)
    for own in held.values():
        letters = sum(len(lines[i].text) for i in own)
        if 2 * sum(len(lines[i].text) for i in own if content[i]) <= letters or 2 * sum(lines[i].linked for i in own) >= letters:
            gone[own] = True
    for i in np.flatnonzero(gone):
        lines[i].element.named = True
    return gone


def main_text(html: str) -> str:
    """The article of a page, its lines joined by one blank; empty if there is none."""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    lines = parser.lines
    if not lines:
        return ""
    ratios = _ratios(lines)
    smooth = _smoothed(ratios)
    cut = _threshold(smooth)
    textual = np.array([_block(x.element).tag in TEXTUAL for x in lines])
    content = (smooth >= cut) & (textual | (ratios >= cut)) & np.array([not x.element.named for x in lines])
    content &= ~_decide(lines, content)
    region = _region(parser, content)
    for e in parser.elements:
        e.inside = e is region or e.parent is not None and e.parent.inside
    whole = region.tag in ("article", "main")
    kept = (x.text for x, good in zip(lines, content, strict=True) if x.element.inside and not x.element.named and (whole or good or _stays(x)))
    return " ".join(kept)


def _stays(line: Line) -> bool:
    """Whether a line below the threshold is kept within the region."""
    tag = _block(line.element).tag
    return tag in HEADINGS or tag in TEXTUAL and 5 * line.linked < 4 * len(line.text)


def _extract(batches):
    for whole in batches:
        for batch in text_slices(whole, "html"):
            texts = [main_text(x) if x else "" for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages``, from its whole html.

    Null and empty html, and pages without content, give an empty text. Null ids and urls and repeated rows are
    given as they come; other columns are not read.
    """
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return own.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    return extract_main_text(table(spark, sf_dir, "pages"))
