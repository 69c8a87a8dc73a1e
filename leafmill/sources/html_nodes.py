"""HTML as elements: an array for each page, or a table of element rows.

A small parser per page is all the Python there is: it numbers the elements in document order and notes for each what is
below and around it. Which elements make blocks, which area is the content, and what is repeated are decided by Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The elements that blocks are made of, and the areas that may hold the content, by preference.
HEADINGS = tuple(f"h{i}" for i in range(1, 7))
CONTAINERS = ("div", "span", "section", "article", "main")
KNOWN = (*HEADINGS, "p", "li", "blockquote", "pre", "img", "video", "source", "a")
BLOCKS = (*HEADINGS, "p", "li", "blockquote", "pre", "div", "section", "article", "main")
SELECTED = frozenset((*KNOWN, *CONTAINERS))
FALLBACK_ROOTS = frozenset(("article", "main", "section", "div"))
PREFERRED = (
    ("id", "js_content"), ("class", "rich_media_content"), ("tag", "article"), ("tag", "main"), ("role", "main"), ("contenteditable", "true"), ("has", "data-block-id"),
    ("has", "data-page-id"), ("class*", "docx"), ("class*", "Doc"), ("class*", "document"), ("class*", "editor"), ("class", "article"), ("class", "content"),
)
_PREFERRED_TAGS = frozenset(value for kind, value in PREFERRED if kind == "tag")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style template noscript title meta link".split())
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
ENDS_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table select body html".split())

# Styles that keep an element from being seen.
NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible)\b", re.I)
OPACITY = re.compile(r"(?:^|;)\s*opacity\s*:\s*\+?(?:0*\.?0+|0+\.)%?\s*(?:;|!|$)", re.I)

#: known_above: pre of the innermost element around that makes blocks of its own; leaf_above: pre of the innermost element
#: around that is read whole, if none in between holds blocks. -1 where there is none.
NODE_FIELDS = [
    T.StructField("pre", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("depth", T.IntegerType()), T.StructField("tag", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())), T.StructField("text", T.StringType()), T.StructField("own_text", T.BooleanType()),
    T.StructField("block_below", T.BooleanType()), T.StructField("content_below", T.BooleanType()), T.StructField("visible", T.BooleanType()),
    T.StructField("prefers", T.ArrayType(T.IntegerType())), T.StructField("known_above", T.IntegerType()), T.StructField("leaf_above", T.IntegerType()),
]
NODES = T.StructType(NODE_FIELDS)
_KINDS = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), *[pa.bool_()] * 4, pa.list_(pa.int32()), pa.int32(), pa.int32()]


# Between which elements an element of a tag isn't looked for, and a tag that is written as most are.
P_SCOPE, CELLS, NO_SCOPE = frozenset(("button", "td", "th", "table")), frozenset(("td", "th", "table")), frozenset()
IN_CELLS = frozenset(("p", "li", "a", "b", "i", "span", "div"))
PLAIN_TAG = re.compile(r"""(/?)([a-zA-Z][a-zA-Z0-9]*)((?: [a-zA-Z_][-a-zA-Z0-9_]*="[^"<>]*")*) ?/?""")
ATTRIBUTE = re.compile(r"""([a-zA-Z_][-a-zA-Z0-9_]*)="([^"]*)\"""")
MOST_TAGS, LONGEST_TAG = 20_000, 200
_tags: dict[str, tuple[str, dict[str, str] | None]] = {}


def _plain_tag(text: str) -> tuple[str, dict[str, str] | None] | None:
    """The name and attributes (null at an end) of what stands between angle brackets; None if only a parser can tell."""
    found = _tags.get(text)
    if found:
        return found
    m = PLAIN_TAG.fullmatch(text)
    if not m or (m[1] and (m[3] or text[-1] in " /")):
        return None
    name = m[2].lower()
    if name in HTMLParser.CDATA_CONTENT_ELEMENTS or name in getattr(HTMLParser, "RCDATA_CONTENT_ELEMENTS", ()) or name == "plaintext":
        return None
    found = name, None if m[1] else {k.lower(): unescape(v) for k, v in reversed(ATTRIBUTE.findall(m[3]))}
    if len(text) <= LONGEST_TAG:
        if len(_tags) >= MOST_TAGS:
            _tags.clear()
        _tags[text] = found
    return found


class _Tree(HTMLParser):
    """Elements in document order, with the range of text pieces that each one has. With styles, hidden elements' pieces are
    left out of what is around them."""

    styles = True

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tags: list[str] = []
        self.attrs: list[dict[str, str]] = []
        self.parents: list[int] = []
        self.children: list[list[int]] = []
        self.pieces: list[str] = []
        self.faded: list[int] = []  # of each piece, the innermost element around it that can't be seen, or -1
        self.ranges: list[list[int]] = []
        self.open: list[int] = []
        self.places: dict[str, list[int]] = {}  # of each tag, its places among the open elements
        self.undisplayed: list[bool] = []  # not displayed, nor is anything in it
        self.unseen: list[bool] = []  # by its visibility, which what is in it inherits
        self.any_dim = False
        self.dim: list[int] = []  # the innermost of an element and those around it that can't be seen, or -1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._open(tag, {k: v or "" for k, v in reversed(attrs)})

    def _open(self, tag: str, own: dict[str, str]) -> None:
        if tag in ENDS_P and self.places.get("p"):
            self._end("p", P_SCOPE)
        for other in ENDS_SAME.get(tag, ()):
            self._end(other, SCOPE)
        node = len(self.tags)
        parent = self.open[-1] if self.open else -1
        self.tags.append(tag)
        self.attrs.append(own)
        self.parents.append(parent)
        self.children.append([])
        self.ranges.append([len(self.pieces), len(self.pieces)])
        gone, unseen, dim = (self.undisplayed[parent], self.unseen[parent], self.dim[parent]) if parent >= 0 else (False, False, -1)
        style = own.get("style", "") if self.styles else ""
        gone = gone or tag in UNSEEN or (self.styles and "hidden" in own) or bool(style and NO_DISPLAY.search(style))
        if style and (found := VISIBILITY.search(style)):
            unseen = found[1].lower() != "visible"
        if unseen or (style and OPACITY.search(style)):
            dim, self.any_dim = node, True
        self.undisplayed.append(gone)
        self.unseen.append(unseen)
        self.dim.append(dim)
        if parent >= 0:
            self.children[parent].append(node)
        if tag not in VOID:
            self.places.setdefault(tag, []).append(len(self.open))
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self._end(tag, CELLS if tag in IN_CELLS else NO_SCOPE)

    def handle_data(self, data: str) -> None:
        if not self.open or not self.undisplayed[self.open[-1]]:
            self.pieces.append(data)
            self.faded.append(self.dim[self.open[-1]] if self.open else -1)

    def _end(self, tag: str, scope: frozenset[str] | set[str]) -> None:
        """Close the innermost element of this tag, unless one of scope is open in it."""
        own = self.places.get(tag)
        if not own:
            return
        k = own[-1]
        for other in scope:
            at = self.places.get(other)
            if at and at[-1] > k:
                return
        for node in self.open[k:]:
            self.ranges[node][1] = len(self.pieces)
            self.places[self.tags[node]].pop()
        del self.open[k:]

    def finish(self, html: str | None) -> None:
        if not self._plain(html or ""):
            self.feed(html or "")
            self.close()
        for node in self.open:
            self.ranges[node][1] = len(self.pieces)

    def _plain(self, html: str) -> bool:
        """Read a page whose tags are all written plainly as the parser would, without it; False if some aren't."""
        first, *rest = html.split("<")
        tokens = []
        for part in rest:
            text, closed, after = part.partition(">")
            tag = _plain_tag(text) if closed else None
            if tag is None:
                return False
            tokens.append((tag, after))
        if first:
            self.handle_data(unescape(first))
        for (tag, own), after in tokens:
            if own is None:
                self.handle_endtag(tag)
            else:
                self._open(tag, own)
            if after:
                self.handle_data(unescape(after) if "&" in after else after)
        return True

    def lasts(self) -> list[int]:
        """The last element in each one."""
        last = list(range(len(self.tags)))
        for i in range(len(last) - 1, 0, -1):
            p = self.parents[i]
            if p >= 0:
                last[p] = max(last[p], last[i])
        return last

    def text(self, node: int) -> str:
        first, end = self.ranges[node]
        if not self.any_dim:
            return "".join(self.pieces[first:end])
        return "".join(piece for piece, dim in zip(self.pieces[first:end], self.faded[first:end]) if dim <= node)

    def shown(self, node: int) -> bool:
        if self.tags[node] == "source" and self.parents[node] >= 0:
            return self.shown(self.parents[node])
        return not self.undisplayed[node] and self.dim[node] != node


def _preferred(tag: str, attrs: dict[str, str]) -> list[int]:
    if not attrs and tag not in _PREFERRED_TAGS:
        return []
    out = []
    for i, (kind, value) in enumerate(PREFERRED):
        found = (
            tag == value if kind == "tag"
            else value in attrs if kind == "has"
            else value in attrs.get("class", "").split() if kind == "class"
            else value in attrs.get("class", "") if kind == "class*"
            else attrs.get(kind) == value
        )
        if found:
            out.append(i)
    return out


def _squeezed(text: str) -> str:
    return " ".join(text.split())


def node_rows(html: str | None) -> list[tuple]:
    """The values of NODE_FIELDS of each element."""
    tree = _Tree()
    tree.finish(html)
    n = len(tree.tags)
    last, block_below, content_below = tree.lasts(), [False] * n, [False] * n
    for i in range(n - 1, -1, -1):
        p, tag = tree.parents[i], tree.tags[i]
        if p >= 0:
            block_below[p] |= block_below[i] or tag in BLOCKS
            content_below[p] |= content_below[i] or (tag in SELECTED and tag != "span")
    rows, depth, leaf, known_above, leaf_above = [], [0] * n, [False] * n, [-1] * n, [-1] * n
    for i in range(n):
        tag, attrs, p = tree.tags[i], tree.attrs[i], tree.parents[i]
        # the text of an element that only holds other blocks is never asked for
        wanted = tag in SELECTED and not (tag in CONTAINERS and block_below[i])
        text = tree.text(i) if wanted else None
        # only containers are asked whether they have a text of their own
        own = False
        if wanted:
            own = bool(text.strip()) if not tree.children[i] else _squeezed(text) != _squeezed(" ".join(tree.text(c) for c in tree.children[i] if tree.dim[c] != c))
        leaf[i] = tag in CONTAINERS and not block_below[i] and (own or not content_below[i])
        if p >= 0:
            depth[i] = depth[p] + 1
            known_above[i] = p if tree.tags[p] in KNOWN else known_above[p]
            leaf_above[i] = p if leaf[p] else -1 if tree.tags[p] in BLOCKS and block_below[p] else leaf_above[p]
        rows.append((i, last[i], depth[i], tag, attrs, text, own, block_below[i], content_below[i], tree.shown(i), _preferred(tag, attrs), known_above[i], leaf_above[i]))
    return rows


def node_arrays(pages: list[list[tuple]], tags: frozenset[str] | None = None) -> pa.Array:
    """The rows of each page (of tags or that may be a content area, if given) as a list of structs."""
    found, ends = [], [0]
    for rows in pages:
        found += [r for r in rows if tags is None or r[3] in tags or r[10]]
        ends.append(len(found))
    columns = [list(c) for c in zip(*found)] or [[] for _ in _KINDS]
    columns[4] = [list(a.items()) for a in columns[4]]
    nodes = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)], names=[f.name for f in NODE_FIELDS])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), nodes)


def page_trees(pages: DataFrame, html_col: str = "html", tags: frozenset[str] | None = None) -> DataFrame:
    """The columns of pages but the html, and nodes: an array of each page's elements (of tags or that may be a content area,
    if given) in document order. No rows move.

    Null or empty html has an empty array. Extra columns stay; one that is called nodes is replaced.
    """
    pages = pages.drop(*[c for c in pages.columns if c == "nodes" and c != html_col])
    carried = [f for f in pages.schema.fields if f.name != html_col]
    at = pages.columns.index(html_col)

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64)
                own = [part.column(i) for i in range(part.num_columns) if i != at]
                nodes = node_arrays([node_rows(html) for html in part.column(at).to_pylist()], tags)
                yield pa.RecordBatch.from_arrays([*own, nodes], names=[*(f.name for f in carried), "nodes"])

    return pages.mapInArrow(trees, T.StructType([*carried, T.StructField("nodes", T.ArrayType(NODES))]))


def dom_nodes(pages: DataFrame, html_col: str = "html", tags: frozenset[str] | None = None) -> DataFrame:
    """The columns of pages but the html, and a row for each element of page_trees(). A column that has the name of a node
    column is replaced."""
    names = {f.name for f in NODE_FIELDS}
    pages = pages.drop(*[c for c in pages.columns if c in names and c != html_col])
    return page_trees(pages, html_col, tags).select(*(c for c in pages.columns if c != html_col), F.inline("nodes"))
