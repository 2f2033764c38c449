"""Main text of web pages by text-to-tag ratio.

The standard library's parser streams a page's tags and text. Text between the borders of block elements is a *line*;
its ratio is its text's length to the number of tags in it. The ratios are smoothed with a Gaussian over neighbouring
lines, weighed, and split into two clusters; lines of the upper one are content. A line weighs a quarter for each element
around it whose tag, role or class says navigation, header, footer, sidebar, notice, advert, form or comments, and for a
list of links, and less the more of it is links: such a line is content only where the rest of the page is no better, as
on a page that is one form. Content lines in one article or main element, or outside of such, make a region; what
weighs as much and lies between them belongs to it, as do headings and running text next to them whose smoothed ratio
is not far below the border. All regions are the text: sibling articles, and a lead beside an article, keep theirs.

Defined cases: a null or empty page, or one without text, gives the empty text; broken and truncated markup is read as far as it
goes, an unfinished tag at the end is dropped; repeated rows are read alike; an empty table gives an empty table. Only
the columns asked for are read.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import arrow_map

# Elements by their part in a page.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html",
    "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
UNREAD = {
    "script", "style", "noscript", "template", "head", "title", "svg", "math", "iframe", "object", "canvas", "audio", "video",
    "button", "select", "option", "datalist", "textarea", "label", "input", "legend",
}
ASIDE = {"form", "fieldset", "nav", "footer", "aside", "menu", "dialog"}
FLOW = HEADINGS | {"p", "blockquote", "pre", "li", "dd", "dt", "td", "th", "figcaption", "b", "i", "em", "strong", "span", "a"}
UNREAD_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "status"}
UNREAD_NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "adbox", "adsense", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
    "commentlist", "consent", "cookie", "cookies", "copyright", "disclaimer", "disqus", "discussion", "footer", "gdpr", "header", "masthead", "login", "menu",
    "menubar", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "overlay", "pager", "pagination", "popup",
    "promo", "promotion", "recommended", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social",
    "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "topbar", "widget", "widgets",
}
#: Starting one of these ends an open one of those (up to the nearest element that holds them).
ENDS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDERS = {"article", "aside", "body", "div", "dl", "figure", "footer", "form", "header", "html", "li", "main", "nav", "ol", "section", "table", "td", "th", "ul"}

#: What text in an element beside the matter counts; how far below the border, as a share, a line next to content may lie.
LOW, NEAR = 0.25, 0.4

_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class _Page(HTMLParser):
    """Collects lines and the tree of their elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        # Elements: parent, tag, and whether its content is never read ("no") or counts little by its tag or role ("low") or name ("named").
        self.parent, self.tag, self.left_out = [-1], [""], [""]
        self.open = [0]
        self.lines: list[tuple[int, str, int, int]] = []  # element, text, tags, characters in links
        self.pieces: list[str] = []
        self.tags = self.linked = self.links = self.muted = 0

    def end_line(self) -> None:
        text = _SPACE.sub(" ", "".join(self.pieces)).strip()
        if text:
            self.lines.append((self.open[-1], text, self.tags, self.linked))
            self.tags = 0
        self.pieces, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.pieces.append(" ")
        if tag in BLOCK:
            self.end_line()
            if tag != "html" and tag != "body":
                self.implied(tag)
        self.tags += 1
        if tag in VOID:
            return
        self.parent.append(self.open[-1])
        self.tag.append(tag)
        self.left_out.append(self.kind(tag, dict(attrs)))
        self.open.append(len(self.tag) - 1)
        self.links += tag == "a"
        self.muted += tag not in BLOCK and self.left_out[-1] == "no"

    def implied(self, tag: str) -> None:
        """Close what the start of this block element closes by itself."""
        for at in range(len(self.open) - 1, 0, -1):
            name = self.tag[self.open[at]]
            if name == "p" or name in ENDS.get(tag, ()):
                self.close_to(at)
                if name == "p":
                    return self.implied(tag)
                return
            if name in HOLDERS and name not in ENDS.get(tag, ()) and not (tag in ("tr", "td", "th") and name in ("td", "th")):
                return

    def close_to(self, at: int) -> None:
        self.links -= sum(self.tag[e] == "a" for e in self.open[at:])
        self.muted -= sum(self.tag[e] not in BLOCK and self.left_out[e] == "no" for e in self.open[at:])
        del self.open[at:]

    def kind(self, tag: str, attrs: dict) -> str:
        if tag in UNREAD or "hidden" in attrs or attrs.get("aria-hidden") == "true" or _HIDDEN.search(attrs.get("style") or ""):
            return "no"
        if tag in ASIDE or (attrs.get("role") or "").lower() in UNREAD_ROLES:
            return "low"
        if tag in ("html", "body", "main"):
            return ""
        names = {n.lower() for a in ("class", "id") for n in _NAME.findall(attrs.get(a) or "")}
        return "named" if names & UNREAD_NAMES else ""

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK and self.tag[self.open[-1]] == tag:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.end_line()
        self.tags += 1
        for at in range(len(self.open) - 1, 0, -1):
            if self.tag[self.open[at]] == tag:
                self.close_to(at)
                return
            # A stray end of an inline element reaches no further than its block; </p> not past what holds paragraphs.
            if (tag not in BLOCK or tag == "p") and self.tag[self.open[at]] in HOLDERS:
                return

    def handle_data(self, data: str) -> None:
        if self.muted:  # an inline element that is left out lies within a line
            return
        self.pieces.append(data)
        if self.links:
            self.linked += len(data.strip())

    def finish(self) -> None:
        rest = self.rawdata
        if self.cdata_elem is None and not re.match(r"<[a-zA-Z/!?]", rest):
            self.close()
        self.end_line()


def smoothed(ratio: np.ndarray, sigma: float = 1.5) -> np.ndarray:
    """Gaussian smoothing; past the ends the first and last line repeat."""
    reach = int(3 * sigma)
    bell = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratio, reach, mode="edge"), bell / bell.sum(), mode="valid")


def threshold(values: np.ndarray) -> float:
    """The border between two clusters of ``values``: two means, moved until they rest."""
    low, high = float(values.min()), float(values.max())
    for _ in range(100):
        border = (low + high) / 2
        upper = values[values > border]
        lower = values[values <= border]
        if not len(upper) or not len(lower) or (low, high) == (lower.mean(), upper.mean()):
            return border
        low, high = float(lower.mean()), float(upper.mean())
    return (low + high) / 2


def weights(page: _Page) -> tuple[np.ndarray, np.ndarray]:
    """How much an element's text counts, by what it and the elements around it are, and the article or main element
    around it (0 without one)."""
    tag, parent = page.tag, page.parent
    n = len(tag)
    # Named containers that hold a page's title or main element are wrappers, not what their name says.
    holds = [t in ("h1", "main") for t in tag]
    for e in range(n - 1, 0, -1):
        if holds[e]:
            holds[parent[e]] = True
    weight, root = np.ones(n), np.zeros(n, dtype=np.int64)
    in_header = [False] * n
    for e in range(1, n):
        p, kind = parent[e], page.left_out[e]
        in_header[e] = in_header[p] or tag[e] == "header"
        own = {"no": 0.0, "low": LOW}.get(kind, 1.0)
        if kind == "named" and not holds[e]:
            own = LOW
        if tag[e] in HEADINGS and in_header[e]:
            own /= LOW  # of a header only the headings count in full
        if tag[e] == "header" and not in_header[p]:
            own = LOW
        weight[e] = weight[p] * own
        root[e] = e if tag[e] in ("article", "main") else root[p]
    return weight, root


def main_text(html: str) -> str:
    page = _Page()
    page.feed(html)
    page.finish()
    if not page.lines:
        return ""
    tag, parent = page.tag, page.parent
    n = len(tag)
    by_element, root_of = weights(page)
    element = np.array([x[0] for x in page.lines])
    size = np.array([len(x[1]) for x in page.lines], dtype=float)
    ratio = size / np.array([max(1, x[2]) for x in page.lines], dtype=float)
    links = np.array([x[3] for x in page.lines], dtype=float) / np.maximum(size, 1)

    def sums(of: np.ndarray) -> np.ndarray:
        total = np.zeros(n)
        np.add.at(total, element, of)
        for e in range(n - 1, 0, -1):
            total[parent[e]] += total[e]
        return total

    # Lists of links: the element and its parents hold little else.
    seen = by_element[element] > 0
    text, link, count = sums(size * seen), sums(size * links * seen), sums(seen.astype(float))
    menu = np.zeros(n, dtype=bool)
    for e in range(1, n):
        menu[e] = menu[parent[e]] or (tag[e] in ("ul", "ol", "dl", "table", "div", "p", "section") and count[e] >= 3 and text[e] > 0 and link[e] > 0.8 * text[e])
    weight = by_element[element] * np.where(menu[element], LOW, 1.0) * (1 - np.minimum(links, 1) * (links >= 0.5))
    seen &= weight > 0
    if not seen.any():
        return ""
    at = np.flatnonzero(seen)
    weight, ratio, element, links = weight[at], ratio[at], element[at], links[at]
    values, own = weight * np.log1p(smoothed(ratio)), weight * np.log1p(ratio)
    border = threshold(values)
    content = values > border
    # A cluster ends with lines whose own ratio is above the border: smoothing bridges gaps, and reaches no further.
    for order in (range(len(at)), range(len(at) - 1, -1, -1)):
        inside = False
        for i in order:
            inside = content[i] and (inside or own[i] > border)
            content[i] = inside
    if not content.any():
        content = weight == weight.max()
    # Content lines of one article or main element, or of no such, are a region. Lines that lie between them belong to it, and
    # so do headings and running text before and after them, unless the smoothed ratio is far below the border.
    keep = content.copy()
    region = root_of[element]
    for r in np.unique(region[content]):
        mine = np.flatnonzero(content & (region == r))
        floor = weight[mine].min()
        first, last = mine[0], mine[-1]
        for i in np.flatnonzero(~content & (weight >= floor)):
            if region[i] != r and not (region[i] and _within(r, region[i], parent)):
                continue
            keep[i] |= first < i < last or (values[i] > NEAR * border and tag[element[i]] in FLOW)
    return "\n".join(page.lines[i][1] for i in at[keep])


def _within(e: int, other: int, parent: list[int]) -> bool:
    while e > other:
        e = parent[e]
    return e == other


def extracted(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep``, ``text`` and ``n_chars`` (code points) of every whole page."""
    rows = pages.select(*keep, F.col(html).alias("_html"))
    kind = rows.select(*keep, F.lit("").alias("text"), F.lit(0).cast("bigint").alias("n_chars")).schema

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [main_text(h) if h else "" for h in batch.column(len(keep)).to_pylist()]
            return pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [*keep, "text", "n_chars"],
            )

        return each

    return arrow_map(rows, make, kind)
