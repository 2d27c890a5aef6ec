"""Main text of HTML pages: streamed parser events, text-to-tag ratios, smoothing, clustering.

The standard library's parser gives a stream of events, from which a page's blocks (lines)
are built as they come. A line's text-to-tag ratio is its characters for each tag in it;
the ratios are smoothed with a Gaussian over the lines of the page, and lines above the
page's threshold (the standard deviation of the smoothed ratios) form the content cluster.
Regions that hold lines of the cluster are selected, whole: article and main elements; on a page without any, the innermost container with
four fifths of the cluster's characters. A short line, a heading or a link in a region is content like its neighbours.

Never content, in a region or not, is text inside menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles
and reader comments: this is decided for each piece of text by the elements around it, told by their tags, roles, and names (class and id).
Names of headings, and of article, main, body and html, tell nothing; a header inside of a region is the article's own. What surrounds a whole article
counts only if it is closed after it (a menu that was left open ends where the article begins), and not if it surrounds all articles. Outside of regions, lists and
lines of nothing but links are menus.

Defined results: null or empty html has an empty text; markup that never closes ends with the
page; repeated rows are extracted alike; other columns pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import free, pieces, small_batches

SIGMA = 1.0
CHUNK = 8 << 20

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul".split())
EXCLUDED = frozenset("applet aside audio button canvas datalist dialog footer form frameset head header iframe map menu nav noembed noframes noscript object option script search select style svg template textarea title video".split())
REGION = frozenset(("article", "main"))
CONTAINER = frozenset("body section div td blockquote center".split())
LISTS = frozenset("ul ol dl dir".split())
IN_HEAD = frozenset("head title base link meta style script noscript template".split())
#: Tags whose start ends an open element of the second set, if no element of the third stands between.
ENDS = {"p": ("p", None), "li": ("li", {"ul", "ol", "menu"}), "td": ("td", {"table"}), "th": ("td", {"table"}), "tr": ("tr", {"table"}), "dt": ("dd", {"dl"}), "dd": ("dt", {"dl"}), "option": ("option", {"select"})}
#: Elements whose names say nothing.
UNNAMED = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())
#: A name marks what is not the article if it begins or ends with one of these words.
MARKS = frozenset("ad ads adbox adslot advert adverts advertisement advertising advertorial breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter popup promo promoted sidebar signup skyscraper sponsor sponsored subscribe subscription toolbar topbar widget widgets".split())
#: Or if it has one of these, and no words but them and those of the next line.
WEAK = frozenset("banner header login notice notices notification notifications promotion related replies reply respond search share sharing social".split())
BESIDE = frozenset("alert area articles bar block bottom box button buttons container content form global icons items links list main message page posts section site stories tools top wrapper".split())
#: Names that begin so tell of a layout.
LAYOUT = frozenset("has no with without".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar".split())
_PARTS = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none", re.IGNORECASE)


class Element:
    """An open element: what excludes its text (elements around it, or itself), and around the region it stands in; region, container, list and whether in a link."""

    __slots__ = ("around", "closed", "container", "excluded", "link", "list", "region", "tag")

    def __init__(self, tag: str, parent: "Element | None"):
        self.tag, self.closed = tag, False
        if parent is None:
            self.excluded, self.around, self.region, self.container, self.list, self.link = (), (), 0, 0, 0, 0
        else:
            self.excluded, self.around, self.region, self.container, self.list, self.link = parent.excluded, parent.around, parent.region, parent.container, parent.list, parent.link


class Line:
    """A block of text: its words, its tags, how many characters and how many of them in links, the links, and where it stands."""

    __slots__ = ("around", "chars", "container", "linked", "links", "list", "region", "tags", "text")

    def __init__(self, text: str, tags: int, chars: int, linked: int, links: int, at: Element):
        self.text, self.tags, self.chars, self.linked, self.links = text, tags, chars, linked, links
        self.around, self.region, self.container, self.list = at.around, at.region, at.container, at.list


def _name_marks(name: str) -> bool:
    words = [w for w in _PARTS.split(_CAMEL.sub("-", name).lower()) if w and not w.isdigit()]
    if not words or words[0] in LAYOUT:
        return False
    return words[0] in MARKS or words[-1] in MARKS or not WEAK.isdisjoint(words) and all(w in WEAK or w in BESIDE for w in words)


def _excludes(tag: str, attrs: list[tuple[str, str | None]], region: int) -> bool:
    """Whether an element's text is not the article's; region: whether in one."""
    if tag in EXCLUDED and not (tag == "header" and region):
        return True
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and (value or "").lower() == "true" or name == "style" and _HIDDEN.search(value or ""):
            return True
        if name == "role" and not ROLES.isdisjoint((value or "").lower().split()):
            return True
        if value and name in ("class", "id") and tag not in UNNAMED:
            names = value.split()
            if tag == "header" or region:
                names = [n for n in names if n.lower() != "header"]
            if any(_name_marks(n) for n in names):
                return True
    return False


class Lines(HTMLParser):
    """The events of one page as Lines; parents has the container around each container."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.tags = self.chars = self.linked = self.links = self.serial = 0
        self.parents: dict[int, int] = {}
        self.open: list[Element] = [Element("", None)]

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.lines.append(Line(text, self.tags, self.chars, self.linked, self.links, self.open[-1]))
            self.parts.clear()
        self.tags = self.chars = self.linked = self.links = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.flush()
        self.tags += 1
        if tag in VOID:
            if tag == "br" and not self.open[-1].excluded:
                self.parts.append(" ")
            return
        if tag in BLOCK and tag not in IN_HEAD:  # a head that was left open ends here
            for at in range(len(self.open) - 1, 0, -1):
                if self.open[at].tag == "head":
                    del self.open[at:]
                    break
        if tag in ENDS:
            own, between = ENDS[tag]
            for at in range(len(self.open) - 1, 0, -1):
                name = self.open[at].tag
                if name == own or name == tag:
                    del self.open[at:]
                    break
                if (between or BLOCK) and name in (between or BLOCK):
                    break
        element = Element(tag, self.open[-1])
        self.serial += 1
        if _excludes(tag, attrs, element.region):
            element.excluded += (element,)
        if tag in REGION and not element.region:
            element.region, element.around, element.excluded = self.serial, element.excluded, tuple(e for e in element.excluded if e is element)
        if tag in REGION or tag in CONTAINER:
            self.parents[self.serial] = element.container
            element.container = self.serial
        if tag in LISTS:
            element.list = self.serial
        if tag == "a":
            element.link = self.serial
            self.links += not element.excluded
        self.open.append(element)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        self.tags += 1
        for at in range(len(self.open) - 1, 0, -1):
            name = self.open[at].tag
            if name == tag:
                self.open[at].closed = True
                del self.open[at:]
                return
            if name in BLOCK and tag not in BLOCK or name in REGION and tag not in ("body", "html", *REGION):
                return

    def handle_data(self, data: str) -> None:
        at = self.open[-1]
        if at.excluded:
            return
        self.parts.append(data)
        size = len("".join(data.split()))
        self.chars += size
        if at.link:
            self.linked += size


def parsed(html: str) -> Lines:
    p = Lines()
    p.feed(html)
    p.close()
    p.flush()
    return p


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing with a window of three sigma, weights renewed at the page's ends."""
    reach = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    over = lambda x: np.convolve(x, kernel)[reach : reach + len(ratios)]
    return over(ratios) / over(np.ones(len(ratios)))


def _menus(lines: list[Line]) -> set[int]:
    """Of lines outside of regions, the places of those that are menus: of several links and nothing else, or in a list of such."""
    whole = [x.linked == x.chars for x in lines]
    items: dict[int, list[int]] = {}
    for i, x in enumerate(lines):
        if x.list:
            items.setdefault(x.list, []).append(i)
    out = {i for i, x in enumerate(lines) if whole[i] and x.links > 1}
    for rows in items.values():
        if len(rows) > 1 and all(whole[i] for i in rows):
            out.update(rows)
    return out


def _innermost(cluster: list[Line], parents: dict[int, int]) -> set[int]:
    """The containers inside of the innermost one with four fifths of the cluster's characters, with it."""
    held: dict[int, int] = {}
    for x in cluster:
        at = x.container
        while at:
            held[at] = held.get(at, 0) + x.chars
            at = parents[at]
    total = sum(x.chars for x in cluster)
    best = max((c for c, n in held.items() if 5 * n >= 4 * total), default=0)  # of nested ones the last to begin
    inside = {best}
    for c in sorted(parents):
        if parents[c] in inside:
            inside.add(c)
    return inside


def content(page: Lines) -> list[Line]:
    """The lines of the selected regions, in page order."""
    lines = page.lines
    if not lines:
        return []
    out = {i for i, x in enumerate(lines) if any(e.closed for e in x.around)}
    if all(i in out for i, x in enumerate(lines) if x.region):
        out = set()  # what surrounds all articles says nothing
    free_lines = [i for i, x in enumerate(lines) if not x.region]
    out |= {free_lines[i] for i in _menus([lines[i] for i in free_lines])}
    ratios = np.array([0 if i in out else (x.chars - x.linked) / (1 + x.tags) for i, x in enumerate(lines)], float)
    smooth = smoothed(ratios)
    threshold = float(np.std(smooth))
    allowed = [x for i, x in enumerate(lines) if i not in out]
    cluster = [x for i, (x, s) in enumerate(zip(lines, smooth, strict=True)) if s >= threshold and i not in out and 2 * x.linked <= x.chars]
    if regions := {x.region for x in cluster if x.region} or {x.region for x in allowed if x.region}:
        return [x for x in allowed if x.region in regions]
    inside = _innermost(cluster, page.parents)
    return [x for x in allowed if x.container in inside]


def main_text(html: str | None) -> str:
    return "\n".join(x.text for x in content(parsed(html))) if html else ""


def extract(df: DataFrame, html: str = "html") -> DataFrame:
    """Replaces the html column by text and n_chars (code points); other columns pass."""
    kept = [c for c in df.columns if c not in (html, "text", "n_chars")]
    small_batches(df)
    rows = df.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{html}`").cast("string").alias(free(df, "_html")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pages = b.column(b.num_columns - 1)
            for a, z in pieces((n or 0 for n in pa.compute.binary_length(pages).to_pylist()), CHUNK):
                part = b.slice(a, z - a)
                texts = [main_text(x) for x in pages.slice(a, z - a).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(kept))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*kept, "text", "n_chars"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "text string", "n_chars long"])
    return rows.mapInArrow(run, schema)
