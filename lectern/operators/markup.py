"""Elements of archived pages by balance: nested markup, ancestor conditions, next-page links.

A page is walked once with the standard HTML parser.  An open tag is pushed, a
closing tag closes the innermost open element of its name (and what is still open inside
it), void elements hold nothing, and what is open at the end ends there.  An
element covers a range of the page's text nodes, so the texts of nested
matches repeat, each once per element that matches.  Scripts, styles and comments hold no text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Bytes of pages handed to a Python worker's output at a time.
LOT = 1 << 23


@dataclass(frozen=True)
class Step:
    """A condition on an element: any of ``tags`` (none: all), all of ``classes``, equal ``attrs``.

    In a path each step is met by an ancestor of the next one's element, or by its parent where the next one has ``child``.
    """

    tags: tuple[str, ...] = ()
    classes: tuple[str, ...] = ()
    attrs: tuple[tuple[str, str], ...] = ()
    child: bool = False

    def met(self, e: Element) -> bool:
        return ((not self.tags or e.tag in self.tags) and all(c in e.attrs.get("class", "").split() for c in self.classes)
                and all(e.attrs.get(k) == v for k, v in self.attrs))


@dataclass
class Element:
    tag: str
    attrs: dict[str, str]
    parent: Element | None
    first: int
    last: int | None = None


@dataclass
class Page:
    """Elements in order of their opening tags, and the stripped, non-blank text nodes."""

    elements: list[Element] = field(default_factory=list)
    nodes: list[str] = field(default_factory=list)


class _Walk(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.page, self.open = Page(), []

    def handle_starttag(self, tag, attrs):
        e = Element(tag, {k: v or "" for k, v in reversed(attrs)}, self.open[-1] if self.open else None, len(self.page.nodes))
        self.page.elements.append(e)
        if tag in VOID:
            e.last = e.first
        else:
            self.open.append(e)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop().last = len(self.page.nodes)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag == tag:
                for e in self.open[i:]:
                    e.last = len(self.page.nodes)
                del self.open[i:]
                return

    def handle_data(self, data):
        text = data.strip()
        if text and not (self.open and self.open[-1].tag in ("script", "style")):
            self.page.nodes.append(text)


def walk(html: str | None) -> Page:
    """Elements and text nodes of a page; null is an empty page."""
    w = _Walk()
    w.feed(html or "")
    w.close()
    for e in w.open:
        e.last = len(w.page.nodes)
    return w.page


def matches(page: Page, path: tuple[Step, ...], within: Element | None = None) -> Iterator[Element]:
    """Elements that end a ``path`` of steps, in page order; ``within`` an element, itself excluded, if given."""
    def reached(e: Element | None, i: int) -> bool:
        """Whether ``e`` or, unless step i + 1 wants its parent, an ancestor of it meets step i, and so on up the path."""
        while e is not None:
            if path[i].met(e) and (i == 0 or reached(e.parent, i - 1)):
                return True
            if path[i + 1].child:
                return False
            e = e.parent
        return False

    def inside(e: Element) -> bool:
        while e is not None:
            e = e.parent
            if e is within:
                return True
        return False
    for e in page.elements:
        if path[-1].met(e) and (len(path) == 1 or reached(e.parent, len(path) - 2)) and (within is None or inside(e)):
            yield e


def select(pages: DataFrame, path: list[Step], *, within: list[Step] | None = None, sep: str = "", first: bool = False,
           keep: tuple[str, ...] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """``keep`` + (element_no, tag, attrs, text): one row per element that ends ``path``, in page order from 0.

    ``text`` joins the element's text nodes by ``sep``, texts of nested elements
    included.  ``within`` looks inside the first element of that path only
    (no rows where there is none); ``first`` stops at the first match.  A page
    that is null, empty or without a match has no rows; each page is parsed once, in place.
    """
    src = pages.select(*keep, F.col(html).alias("_html"))
    out_schema = T.StructType([*src.drop("_html").schema.fields, *T._parse_datatype_string(
        "element_no long, tag string, attrs map<string,string>, text string").fields])
    path, outer = tuple(path), tuple(within) if within else None
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows, held = [], [], 0

            def ready() -> pa.RecordBatch:
                cols = [batch.column(i).take(pa.array(at, pa.int64())) for i in range(n)]
                own = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string()))]
                return pa.RecordBatch.from_arrays(cols + own, out_schema.names)
            for i, text in enumerate(batch.column(n)):
                page = walk(text.as_py())
                scope = next(matches(page, outer), None) if outer else None
                if outer and scope is None:
                    continue
                for no, e in enumerate(matches(page, path, scope)):
                    at.append(i)
                    rows.append((no, e.tag, list(e.attrs.items()), sep.join(page.nodes[e.first:e.last])))
                    held += len(rows[-1][3])
                    if first:
                        break
                if held >= LOT:
                    yield ready()
                    at, rows, held = [], [], 0
            yield ready()
    return src.mapInArrow(run, out_schema)


def joined_texts(pages: DataFrame, path: list[Step], *, within: list[Step] | None = None, out: str = "text") -> DataFrame:
    """(page_id, ``out``): non-blank texts of all matches in page order, one a line; '' for a page without any."""
    found = select(pages, path, within=within, keep=("page_id",)).where(F.col("text") != "")
    per = found.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("element_no", "text"))), lambda x: x["text"]), "\n").alias(out))
    return pages.select("page_id").join(per, "page_id", "left").select("page_id", F.coalesce(out, F.lit("")).alias(out))


def absolute(href: Column, base: Column) -> Column:
    """An address relative to its page's: absolute ones stay, '//host' and '/path' take the page's scheme and host,
    '?query' and others its folder; the fragment goes."""
    href = F.regexp_replace(F.trim(href), "#.*$", "")
    site = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    plain = F.regexp_replace(base, "[?#].*$", "")
    folder = F.when(F.length(plain) > F.length(site), F.regexp_replace(plain, "[^/]*$", "")).otherwise(F.concat(site, F.lit("/")))
    return (F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.regexp_extract(base, "^([^/]*)", 1), href))
            .when(href.startswith("/"), F.concat(site, href)).when(href.startswith("?"), F.concat(plain, href))
            .when(href == "", base).otherwise(F.concat(folder, href)))


#: The paths of a next-page link: marked by its relation inside an item of class "next", or by the item's class alone.
NEXT_LINKS = ([Step(classes=("next",)), Step(("a",), attrs=(("rel", "next"),), child=True)], [Step(("li",), ("the-next-page",)), Step(("a",))])


def next_links(pages: DataFrame, path: list[Step]) -> DataFrame:
    """(page_id, url, next_url): the first link that ends ``path``, as an absolute address; null without one or without an address."""
    links = select(pages, path, first=True)
    href = F.element_at("attrs", "href")
    links = links.select("page_id", F.when(F.trim(href) != "", absolute(href, F.col("url"))).alias("next_url"))
    return pages.select("page_id", "url").join(links, "page_id", "left")
