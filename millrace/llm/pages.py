"""Main text of web pages: parser events, text-to-tag ratios, smoothing, clusters of lines.

The standard library's parser streams over a page. Its events make lines (blocks), each with its
characters, the tags since the line before and the characters inside links. A line's ratio is
characters that are no link text over tags. Ratios are smoothed by a Gaussian over neighbouring
lines; two means cluster them into content and the rest. The region is an article or main element
if the page has one that holds most of the content lines' text, and else the innermost box that
holds all content lines. Of the region every line is taken, however short, except those inside elements that are
never main text: menus, headers and footers of the page, sidebars, notices, adverts, forms,
scripts, styles and comments.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import text_of

SIGMA = 1.0                     # lines
# Fixed sets of element names.
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt "
             "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend "
             "li main menu nav ol optgroup option p pre search section summary table tbody td tfoot "
             "th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
NEVER = set("script style noscript template head title nav aside form button select textarea "
            "iframe object svg canvas dialog menu search audio video".split())
PAGE_EDGE = {"header", "footer"}           # of the page; of an article only the footer
REGIONS = {"article", "main"}
CLOSED_BY = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"},
             "tr": {"tr", "tbody", "thead", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"},
             "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}}
SCOPES = {"table", "ul", "ol", "dl", "select", "article", "section", "div", "body", "main"}
LABELS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adsbox|sponsor\w*|promo\w*|banner\w*|menus?|nav|navbar|"
    r"navigation|breadcrumb\w*|side-?bar\w*|rail|widgets?|comment\w*|disqus\w*|repl(?:y|ies)|"
    r"respond|discussion|cookies?\w*|consent|gdpr|notices?|alerts?|pop-?up\w*|modal|overlay|"
    r"newsletter\w*|subscri\w*|sign-?up|log-?in|shar(?:e|ing)\w*|social\w*|related\w*|recommend\w*|"
    r"footer\w*|masthead|(?:site|page|top)-?header|pagination|pager|toolbar|skip-link|legal|"
    r"copyright|disclaimer)(?=$|[\s_-])", re.I)
HEADER_LABEL = re.compile(r"^header$", re.I)
# Tells of another part of the page, as in "has-sidebar".
ABOUT_OTHERS = re.compile(r"(?:^|(?<=\s))(?:has|with|without|no|is)[-_]\S+", re.I)
# Labels that hold for all that stands inside, articles too.
CERTAIN = re.compile(r"comment|disqus|repl|respond|discussion|related|recommend|side-?bar|promo", re.I)
# Labels that parts of an article's own text also have: inside an article its lines decide.
UNSURE = re.compile(r"^(?:(?!comment|disqus|repl|respond|recommend|side-?bar|promo).)*"
                    r"(?:discussion|related|notices?|alerts?|legal|disclaimer|copyright)", re.I)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog",
         "alertdialog", "menu", "menubar", "toolbar", "alert", "advertisement", "note"}
SPACE = re.compile(r"[ \t\n\r\f\v\xa0\s]+")


@dataclass
class Line:
    text: str
    tags: int
    linked: int
    box: int                        # number of the innermost element around it, -1 for none
    dropped: bool


class Reader(HTMLParser):
    """Lines of a page, in order. Broken nesting is mended as browsers do in the common cases."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        # Elements left out for their class or id, and whether articles inside go as well.
        self.labelled: dict[int, bool] = {}
        # Labelled elements inside an article whose lines decide.
        self.unsure: set[int] = set()
        # By number of element; elements are numbered as they begin, so parents come first.
        self.kind: list[str] = []
        self.parent: list[int] = []
        self.regions = 0                        # open article and main elements
        self.open: list[tuple[str, int, bool]] = []
        self.parts: list[str] = []
        self.tags = self.linked = self.in_links = 0

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        self.parts.clear()
        if text:
            _, box, inner = self.open[-1] if self.open else ("", -1, False)
            self.lines.append(Line(text, self.tags, self.linked, box, inner))
            self.tags = 0
        self.linked = 0

    def _close(self, at: int) -> None:
        if any(tag in BLOCKS or tag in NEVER for tag, _, _ in self.open[at:]):
            self.flush()
        for tag, _, _ in self.open[at:]:
            self.in_links -= tag == "a"
            self.regions -= tag in REGIONS
        del self.open[at:]

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in VOID:
            if tag in BLOCKS:
                self.flush()
            elif tag in ("br", "img"):
                self.parts.append(" ")
            return
        if tag in BLOCKS or tag in NEVER:
            self.flush()
        for at in range(len(self.open) - 1, -1, -1):
            name = self.open[at][0]
            if tag in CLOSED_BY.get(name, ()):
                self._close(at)
                break
            if name in SCOPES or name in NEVER:
                break
        attrs = dict(attrs)
        dropped = bool(self.open and self.open[-1][2]) or self._is_dropped(tag, attrs)
        names = [ABOUT_OTHERS.sub("", attrs.get(a) or "") for a in ("class", "id")]
        label = next((v for v in names if LABELS.search(v)
                      or HEADER_LABEL.search(v) and not self.regions), None)
        if label and tag not in ("html", "body", "main", "h1"):
            if self.regions and UNSURE.search(label):
                self.unsure.add(len(self.kind))
            else:
                self.labelled[len(self.kind)] = bool(CERTAIN.search(label))
        elif tag in REGIONS:
            # What is around an article is a frame, whatever its label, if that is not certain.
            if not any(self.labelled.get(n) for _, n, _ in self.open):
                for _, n, _ in self.open:
                    self.labelled.pop(n, None)
        self.kind.append(tag)
        self.parent.append(self.open[-1][1] if self.open else -1)
        self.regions += tag in REGIONS
        self.open.append((tag, len(self.kind) - 1, dropped))
        self.in_links += tag == "a"

    def _is_dropped(self, tag: str, attrs: dict) -> bool:
        if tag in NEVER or "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true":
            return True
        if tag == "footer" or tag == "header" and not self.regions:
            return True
        if tag in ("html", "body", *REGIONS, "h1"):
            return False
        if (attrs.get("role") or "").lower() in ROLES:
            return True
        return bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden",
                              attrs.get("style") or "", re.I))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.tags += 1
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                self._close(at)
                return
            if tag not in BLOCKS and self.open[at][0] in BLOCKS:
                return                      # an inline end tag does not close a block
        if tag in BLOCKS:
            self.flush()

    def handle_data(self, data):
        if self.open and self.open[-1][0] in ("script", "style"):
            return
        self.parts.append(data)
        if self.in_links:
            self.linked += len(data)

    def close(self):
        super().close()
        self.flush()


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """A Gaussian mean of the neighbours within three ``sigma``; the ends are repeated."""
    reach = max(1, round(3 * sigma))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(values, reach, mode="edge"), weights / weights.sum(), mode="valid")


def two_means(values: np.ndarray) -> float:
    """The border between two clusters of numbers (Lloyd's iterations from both extremes)."""
    low, high = float(values.min()), float(values.max())
    for _ in range(100):
        border = (low + high) / 2
        upper = values > border
        if not upper.any() or upper.all():
            return border
        new = float(values[~upper].mean()), float(values[upper].mean())
        if new == (low, high):
            return border
        low, high = new
    return (low + high) / 2


def _inside(reader: Reader, marked) -> list[bool]:
    """For each element whether it or an element around it is marked; the last entry is for none."""
    out: list[bool] = []
    for n, parent in enumerate(reader.parent):
        out.append(n in marked or parent >= 0 and out[parent])
    return out + [False]


def _held(reader: Reader, boxes) -> list[int]:
    """For each element how many of the boxes lie in it."""
    held = [0] * (len(reader.parent) + 1)
    for n in boxes:
        held[n] += 1
    for n in range(len(reader.parent) - 1, -1, -1):
        if reader.parent[n] >= 0:
            held[reader.parent[n]] += held[n]
    return held


def main_text(html: str) -> str:
    """The main text of one page: its lines joined by line feeds; empty if it has none."""
    reader = Reader()
    reader.feed(html)
    reader.close()
    lines = [x for x in reader.lines if not x.dropped]
    labelled = _inside(reader, reader.labelled)
    # If labels leave nothing they do not mean what they say.
    lines = [x for x in lines if not labelled[x.box]] or lines
    if not lines:
        return ""
    ratio = np.array([max(0, len(x.text) - x.linked) / max(1, x.tags) for x in lines])
    level = smooth(ratio)
    border = min(two_means(level), level.max()) * (1 - 1e-9)       # equal levels stay together
    # A part of an article with an unsure label goes unless a line of its own is content.
    sure = _held(reader, [x.box for x, r in zip(lines, ratio) if r >= border])
    empty = _inside(reader, {n for n in reader.unsure if not sure[n]})
    content = [x for x, r in zip(lines, level) if r >= border and not empty[x.box]]
    every, lines = lines, [x for x in lines if not empty[x.box]]
    if not content:
        return "\n".join(x.text for x in lines)
    region = _inside(reader, {n for n, kind in enumerate(reader.kind) if kind in REGIONS})
    if all(region[x.box] for x in content):
        # Whole articles, the outermost first: those with content, and others with a line that
        # is half as dense as content has to be.
        some = _held(reader, [x.box for x, r in zip(every, ratio) if r >= border / 2 and not empty[x.box]])
        picked = _inside(reader, {n for n, kind in enumerate(reader.kind) if kind in REGIONS and some[n]})
    else:
        held = _held(reader, [x.box for x in content])
        boxes = [n for n, chars in enumerate(held[:-1]) if chars == len(content) and reader.kind[n] in (
            "div", "section", "td", "body", "html", "center", "table", "main", "article")]
        # Those that hold all lie inside each other; the last one began last.
        picked = _inside(reader, {boxes[-1]}) if boxes else None
    return "\n".join(x.text for x in lines if picked is None or picked[x.box])


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages`` (``page_id, url, html``).

    A null or empty page has an empty text. Repeated rows are read each on its own; other
    columns are ignored.
    """
    def run(batches):
        for batch in batches:
            texts = [main_text(h) for h in text_of(batch, "html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array(list(map(len, texts)), pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
