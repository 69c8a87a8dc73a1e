"""Pages of items that may hold items, as a row for each item that is read by itself, with what is in it and around it.

Which elements are in or around an item is known where a page is parsed; what an item becomes is decided by Spark.
"""

from __future__ import annotations

import re

from pyspark.sql import types as T

from ..functions.urls import resolve
from ..operators.merge import squeeze
from .html_marks import Marks, Units, clean_text
from .html_nodes import HEADINGS

# The classes of the family's pages.
ITEM, ZONE, BULLET, SECTION, CONTENT, GRID, GRID_CELL = "vc-doc-item", "block-text", "bulletlist", "level2-section", "vc-course-content", "table", "table_cell"
LIST_MARKS = frozenset(("bullet_container", "bullet-dot", BULLET))
CHROME = frozenset(("course-complete", "next-chapter-card"))
QUOTES = frozenset(("quote_container", "callout"))
CARD = frozenset(("block-file", "video"))
_WIDTH = re.compile(r"table_([0-9]{1,9})")

_STRINGS = T.ArrayType(T.StringType())
#: What an item shows at one end of its tree: its first list line, else its zones, else all it has.
_END = T.StructType([T.StructField("bullet", T.StringType()), T.StructField("zones", _STRINGS), T.StructField("whole", T.StringType())])
_CELL = T.StructType([T.StructField("nested", T.ArrayType(_END)), T.StructField("own", T.StringType())])
#: What both readers of such pages ask of an item.
ITEM_FIELDS = [
    T.StructField("pre", T.IntegerType()), T.StructField("classes", _STRINGS), T.StructField("first_classes", _STRINGS), T.StructField("is_list", T.BooleanType()), T.StructField("shown", T.ArrayType(_END)),
    T.StructField("code", T.StringType()), T.StructField("language", T.StringType()), T.StructField("quoted", T.BooleanType()), T.StructField("width", T.IntegerType()), T.StructField("cells", T.ArrayType(_CELL)),
]
#: way: the numbers of the items around and of the item itself among those that are read; level and title: of a heading that is
#: no item, whose other fields are null.
COURSE_FIELDS = [
    *ITEM_FIELDS, T.StructField("way", T.ArrayType(T.IntegerType())), T.StructField("depth", T.IntegerType()), T.StructField("video", T.StructType([T.StructField("src", T.StringType()), T.StructField("text", T.StringType())])),
    T.StructField("pictures", T.ArrayType(T.MapType(T.StringType(), T.StringType()))), T.StructField("level", T.IntegerType()), T.StructField("title", T.StringType()),
]


class Items:
    """Of each item its parent, and what the elements in it say, the first of each kind; around: of each element the innermost
    item, grid, cell and video card around it, -1 for none."""

    def __init__(self, tree: Marks) -> None:
        self.tree, n = tree, len(tree.tags)
        self.order: list[int] = []
        self.parent: dict[int, int] = {}
        self.nested: dict[int, list[int]] = {}
        self.bullets: dict[int, int] = {}
        self.zones: dict[int, list[int]] = {}
        self.lists: set[int] = set()
        self.code: dict[int, int] = {}
        self.language: dict[int, int] = {}
        self.quoted: dict[int, int] = {}
        self.grid: dict[int, int] = {}
        self.cells: dict[int, list[int]] = {}
        self.in_cell: dict[int, list[int]] = {}
        self.around: list[tuple[int, int, int, int]] = [(-1, -1, -1, -1)] * n
        inner = [(-1, -1, -1, -1)] * n
        for i in range(n):
            p, names = tree.parents[i], tree.names[i]
            around = self.around[i] = inner[p] if p >= 0 else (-1, -1, -1, -1)
            if not names:
                inner[i] = around
                continue
            item, grid, cell, card = around
            if item >= 0:
                if BULLET in names:
                    self.bullets.setdefault(item, i)
                elif ZONE in names:
                    self.zones.setdefault(item, []).append(i)
                if not LIST_MARKS.isdisjoint(names):
                    self.lists.add(item)
                if "block-code-content" in names:
                    self._first(self.code, item, i)
                if "block-code-language" in names:
                    self._first(self.language, item, i)
                if not QUOTES.isdisjoint(names):
                    self._first(self.quoted, item, i)
                if GRID in names:
                    self._first(self.grid, item, i)
            if GRID_CELL in names and grid >= 0:
                self.cells.setdefault(grid, []).append(i)
            if ITEM in names:
                self.order.append(i)
                self.parent[i] = item
                if item >= 0:
                    self.nested.setdefault(item, []).append(i)
                if cell >= 0 and item < cell:
                    self.in_cell.setdefault(cell, []).append(i)
            inner[i] = (i if ITEM in names else item, i if GRID in names else grid, i if GRID_CELL in names else cell, i if CARD.issubset(names) else card)

    def _first(self, found: dict[int, int], item: int, node: int) -> None:
        """node for all items around that have none: where one has it, so have those around it."""
        while item >= 0 and item not in found:
            found[item] = node
            item = self.parent[item]

    def shown(self, item: int) -> list[dict]:
        """The ends of an item's tree that no list line on the way hides."""
        out, waiting = [], [item]
        while waiting:
            i = waiting.pop()
            if i in self.nested and i not in self.bullets:
                waiting += reversed(self.nested[i])
                continue
            bullet, zones = self.bullets.get(i), self.zones.get(i)
            inside = self.tree.inside
            out.append({"bullet": None if bullet is None else inside(bullet), "zones": [inside(z) for z in zones] if bullet is None and zones else None, "whole": inside(i) if bullet is None and not zones else None})
        return out

    def has_rows(self, item: int) -> bool:
        """Whether the first grid in an item has cells and a class that says how many make a row."""
        grid = self.grid.get(item)
        return grid is not None and grid in self.cells and bool(self._width(grid))

    def _width(self, grid: int) -> int | None:
        return next((int(m[1]) for m in map(_WIDTH.fullmatch, self.tree.names[grid]) if m), None)

    def fields(self, item: int) -> tuple:
        """The values of ITEM_FIELDS."""
        tree, code, language, grid = self.tree, self.code.get(item), self.language.get(item), self.grid.get(item)
        width, cells = None, None
        if grid is not None:
            width = self._width(grid)
            cells = [{"nested": [e for x in self.in_cell[c] for e in self.shown(x)] if c in self.in_cell else None, "own": tree.inside(c)} for c in self.cells.get(grid, ())] if width else None
        return (
            item, tree.names[item], tree.names[tree.children[item][0]] if tree.children[item] else [], item in self.lists, self.shown(item), None if code is None else tree.text(code), None if language is None else tree.text(language),
            item in self.quoted, width, cells or None,
        )


def _chain(tree: Marks, test) -> list[bool]:
    """Of each element, whether one around it passes."""
    out = [False] * len(tree.tags)
    for i, p in enumerate(tree.parents):
        out[i] = p >= 0 and (out[p] or test(p))
    return out


def _videos(items: Items, url: str | None) -> dict[int, dict]:
    """The first video card of each item, if it has a secure address."""
    tree = items.tree
    cards, films, titles = {}, {}, {}
    for i, names in enumerate(tree.names):
        item, _, _, card = items.around[i]
        if item >= 0 and CARD.issubset(names):
            cards.setdefault(item, i)
        if card >= 0 and tree.tags[i] == "video" and "video-preview" in names:
            films.setdefault(card, i)
        if card >= 0 and "title" in names:
            titles.setdefault(card, i)
    out = {}
    for item, card in cards.items():
        src = tree.attrs[films[card]].get("src", "").strip(" ") if card in films else ""
        address = (resolve(src, url) or (src,))[0] if src else ""
        if address.startswith("https:"):
            out[item] = {"src": address, "text": (squeeze(tree.text(titles[card])) if card in titles else "") or "Video"}
    return out


def course_rows(tree: Marks, url: str | None) -> list[tuple]:
    """The values of COURSE_FIELDS of each item that is read by itself, which is so if all the items around it that count are
    list items, and of each heading outside of items. Items that count are in the course and, if it has sections, in one."""
    items = Items(tree)
    is_chrome = lambda i: not CHROME.isdisjoint(tree.names[i])
    chrome, section, root = _chain(tree, is_chrome), _chain(tree, lambda i: SECTION in tree.names[i]), _chain(tree, lambda i: tree.tags[i] == "main" or CONTENT in tree.names[i])
    sectioned = any(section[i] and root[i] for i in items.order)
    counts = lambda i: root[i] and not chrome[i] and (section[i] or not sectioned)
    videos = _videos(items, url)
    # of each item: the numbers on the way to it, how many items are around it, and whether those in it that count are read
    ways, depths, opens, numbers, read = {-1: ()}, {-1: -1}, {-1: None}, {}, []
    for i in items.order:
        p = items.parent[i]
        depths[i] = depths[p] + 1
        live = counts(i) and not is_chrome(i)
        reads = live and (p < 0 or opens[p] is True)
        opens[i] = opens[p] if not live else (i in items.lists) and opens[p] is not False
        ways[i] = ways[p]
        if reads:
            numbers[p] = numbers.get(p, 0) + 1
            ways[i] = (*ways[p], numbers[p])
            read.append(i)
    pictures: dict[int, list] = {i: [] for i in read}
    for i, tag in enumerate(tree.tags):
        if tag == "img":
            item = owner = items.around[i][0]
            while item >= 0:
                if item in pictures and (item == owner or item not in items.lists or item not in items.nested):
                    pictures[item].append(list(tree.attrs[i].items()))
                item = items.parent[item]
    out = [(*items.fields(i), list(ways[i]), depths[i], videos.get(i), pictures[i], None, None) for i in read]
    blank = (None,) * (len(COURSE_FIELDS) - 3)
    titles = [i for i, tag in enumerate(tree.tags) if tag in ("h2", "h3", "h4", "h5", "h6") and items.around[i][0] < 0 and counts(i)]
    return out + [(i, *blank, int(tree.tags[i][1]), tree.text(i)) for i in titles]


def page_course_rows(html: str | None, url: str | None) -> list[tuple]:
    tree = Marks(tight=True)
    tree.finish(html)
    return course_rows(tree, url)


# ---- long articles


# The classes of an article's text, of its opening text and of its title, and the least characters of that.
ARTICLE, OPENING, AROUND_OPENING = "feishu-doc-content", "post-content", "content-container"
TITLES = ("post-title", "article-title", "article_detail_title", "article-detail-title", "topic-title")
LEAST_TITLE = 4
_LEVEL = re.compile("doc-heading-[1-9]")

_PART = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("at", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("inline", T.StringType()), T.StructField("attrs", T.MapType(T.StringType(), T.StringType()))])
#: kind: item, opening or heading; whole: an item that is a heading, code or a grid; quote: the quote that holds an item; depth:
#: list items around; inline: of an opening text or a heading, its contents; pictured: an opening text with pictures; parts: the
#: texts and pictures in it, each with the place that it follows; silent: none of them says anything.
ARTICLE_FIELDS = [
    *ITEM_FIELDS, T.StructField("kind", T.StringType()), T.StructField("whole", T.BooleanType()), T.StructField("quote", T.IntegerType()), T.StructField("depth", T.IntegerType()), T.StructField("level", T.IntegerType()), T.StructField("inline", T.StringType()),
    T.StructField("pictured", T.BooleanType()), T.StructField("silent", T.BooleanType()), T.StructField("parts", T.ArrayType(_PART)),
]


def article_title(tree: Marks) -> str:
    """The first of four characters or more, by kind and then by place."""
    tests = (*(lambda i, name=name: name in tree.names[i] for name in TITLES), lambda i: tree.tags[i] == "h1")
    found = (squeeze(tree.text(i)) for test in tests for i in range(len(tree.tags)) if test(i))
    return next((t for t in found if len(t) >= LEAST_TITLE), "")


def _parts(tree: Units, owner: int) -> list[dict]:
    """Texts and pictures of an element; what follows an item in it comes after that item's end."""
    out, start = [], owner
    for at, (kind, inline, node) in enumerate(tree.parts(owner)):
        if kind == "item":
            start = tree.last[node]
        out.append({"start": owner if kind == "item" else start, "at": at, "kind": kind, "inline": inline, "attrs": list(tree.attrs[node].items()) if kind == "image" else None})
    return out


def article_rows(tree: Units, url: str | None = None) -> list[tuple]:
    """The values of ARTICLE_FIELDS of each item that is read by itself, which none is in a heading, code or grid, of each
    opening text, and of each heading outside of items that isn't the title."""
    items, n = Items(tree), len(tree.tags)
    within, opened = _chain(tree, lambda i: ARTICLE in tree.names[i]), _chain(tree, lambda i: OPENING in tree.names[i])
    blank, out = (None,) * len(ITEM_FIELDS[1:]), []
    # what the items around an item say of it: whether one is whole, how many are list items, and the first quote
    states: dict[int, tuple[bool, int, int | None]] = {-1: (False, 0, None)}
    for i in items.order:
        hidden, depth, quote = states[i] = states[items.parent[i]]
        if not (within[i] or opened[i]):
            continue
        code = items.code.get(i)
        # as code is normalised: nothing but blanks and line ends is no code
        whole = any(map(_LEVEL.fullmatch, tree.names[i])) or (code is not None and bool(clean_text(tree.text(code)).strip(" \t\r\n"))) or items.has_rows(i)
        states[i] = hidden or whole, depth + (i in items.lists), i if quote is None and i in items.quoted else quote
        if hidden:
            continue
        parts = [] if whole else _parts(tree, i)
        silent = not any(p["kind"] != "text" or squeeze(p["inline"]) for p in parts)
        if quote is None and i in items.quoted and not whole:
            quote = i
        out.append((*items.fields(i), "item", whole, quote, depth, None, None, None, silent, [p for p in parts if p["kind"] != "item"]))
    holders = set()
    for i in range(n):
        if ARTICLE in tree.names[i]:
            p = tree.parents[i]
            while p >= 0:
                if AROUND_OPENING in tree.names[p]:
                    holders.add(p)
                p = tree.parents[p]
    title = None
    for i in range(n):
        if OPENING in tree.names[i] and tree.parents[i] in holders:
            pictured = any(tree.tags[k] == "img" for k in range(i + 1, tree.last[i] + 1))
            out.append((i, *blank, "opening", False, None, 0, None, tree.inside(i), pictured, None, [p for p in _parts(tree, i) if p["kind"] != "item"]))
        if tree.tags[i] in HEADINGS and within[i] and items.around[i][0] < 0:
            title, text = article_title(tree) if title is None else title, squeeze(tree.text(i))
            if text and text != title:
                out.append((i, *blank, "heading", False, None, 0, int(tree.tags[i][1]), text, None, None, []))
    return out


def page_article_rows(html: str | None, url: str | None) -> list[tuple]:
    tree = Units(ITEM, frozenset((ZONE, BULLET)))
    tree.finish(html)
    return article_rows(tree)
