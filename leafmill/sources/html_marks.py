"""Elements of the site families' pages with their classes and inline Markdown, and rows of many pages at once.

Inline Markdown nests as elements do, so it is made where the page is parsed, for the elements that a family asks for; what
a block becomes, and in which order blocks stand, is decided by Spark.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Generator, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..operators.merge import squeeze
from .html_nodes import _Tree

_HIDDEN_CHARACTERS = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]|[%s]" % "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0xFEFF, 0xFEFF))))
_BOLD, _ITALIC, _STRUCK = re.compile(r"font-weight\s*:\s*(?:bold|[6-9]00)"), re.compile(r"font-style\s*:\s*italic"), re.compile(r"text-decoration[^;]*line-through")
_MARKED_TAGS = frozenset(("strong", "b", "em", "i", "s", "del"))
#: Pages whose rows go to Spark at once.
PAGES_AT_ONCE = 64


def clean_text(text: str) -> str:
    """Without the characters that can't be seen."""
    return _HIDDEN_CHARACTERS.sub("", text)


def _label(text: str) -> str:
    return re.sub(r"([\\\[\]])", r"\\\1", text.strip())


def _marked(text: str, mark: str, tight: bool) -> str:
    """mark around text; tight keeps white space outside."""
    if not tight:
        return f"{mark}{text}{mark}"
    bare = text.strip()
    return text.replace(bare, f"{mark}{bare}{mark}", 1) if bare else text


def unrolled(call: Generator):
    """What a generator returns that yields the calls it waits for, as these do in turn: recursion without the interpreter's
    stack, for pages that nest deeply."""
    stack, result = [call], None
    while stack:
        try:
            stack.append(stack[-1].send(result))
            result = None
        except StopIteration as end:
            stack.pop()
            result = end.value
    return result


class Marks(_Tree):
    """tight: the rules of pages whose styles are also classes, with white space outside of marks."""

    styles = False

    def __init__(self, tight: bool) -> None:
        super().__init__()
        self.tight = tight
        self.skipped = {"bullet-dot"} if tight else {"ignore-dom"}
        self.media = {"img", "svg", "button", *(("video", "audio", "source") if tight else ())}

    def classes(self, node: int) -> list[str]:
        return self.names[node]

    def finish(self, html: str | None) -> None:
        super().finish(html)
        self.last = self.lasts()
        self.names = [a["class"].split() if "class" in a else [] for a in self.attrs]
        self.clean = not _HIDDEN_CHARACTERS.search("".join(self.pieces)) and not any("href" in a and _HIDDEN_CHARACTERS.search(a["href"]) for a in self.attrs)
        self.marked = [None] * len(self.tags), [None] * len(self.tags)

    def inside(self, node: int) -> str:
        """The inline Markdown of an element's contents."""
        return self._marks(node)[0][node]

    def inline(self, node: int) -> str:
        return self._marks(node)[1][node]

    def _marks(self, first: int) -> tuple[list[str | None], list[str | None]]:
        """inside and inline, worked out once for an element and those in it, the innermost first."""
        inside, inline = self.marked
        if inside[first] is None:
            for node in range(self.last[first], first - 1, -1):
                if inside[node] is not None:
                    continue
                start, end = self.ranges[node]
                if self.children[node]:
                    parts, at = [], start
                    for child in self.children[node]:
                        own, after = self.ranges[child]
                        parts += self.pieces[at:own]
                        parts.append(inline[child])
                        at = after
                    text = "".join(parts + self.pieces[at:end])
                else:
                    text = "".join(self.pieces[start:end])
                inside[node] = text if self.clean else _HIDDEN_CHARACTERS.sub("", text)
                inline[node] = self._dressed(node, inside[node])
        return self.marked

    def _dressed(self, node: int, text: str) -> str:
        tag, attrs, names = self.tags[node], self.attrs[node], self.names[node]
        if tag == "br":
            return "<br>"
        if not text or tag in self.media or (names and not self.skipped.isdisjoint(names)):
            return ""
        if tag == "a" and attrs.get("href"):
            return f"[{_label(squeeze(text))}]({attrs['href'].strip().replace('(', '%28').replace(')', '%29')})"
        style = attrs.get("style", "").lower()
        if not style and tag not in _MARKED_TAGS and not (self.tight and names):
            return text
        for mark, tags, pattern, name in (("**", ("strong", "b"), _BOLD, "bold"), ("*", ("em", "i"), _ITALIC, "italic"), ("~~", ("s", "del"), _STRUCK, "strikethrough")):
            if tag in tags or pattern.search(style) or (self.tight and name in names):
                text = _marked(text, mark, self.tight)
        return text

    def rows(self, wanted: frozenset[str]) -> list[tuple]:
        """A row for each element; those of the wanted classes, and table cells, with inline Markdown and plain content."""
        n = len(self.tags)
        last, lines, out = self.last, [()] * n, []
        for i in range(n):
            p, names = self.parents[i], self.classes(i)
            if p >= 0:
                lines[i] = (*lines[p], {"pre": p, "tag": self.tags[p], "classes": self.classes(p), "block_id": self.attrs[p].get("data-block-id")})
            asked = bool(wanted.intersection(names)) or self.tags[i] in ("td", "th", "h1", "h2", "h3", "h4", "h5", "h6")
            out.append((i, last[i], self.tags[i], names, list(self.attrs[i].items()), list(lines[i]), self.inside(i) if asked else None, self.text(i) if asked else None))
        return out


def mark_rows(html: str | None, wanted: frozenset[str], tight: bool) -> list[tuple]:
    tree = Marks(tight)
    tree.finish(html)
    return tree.rows(wanted)


def page_rows(pages: DataFrame, fields: list[T.StructField], rows_of: Callable[[str | None, str | None], list[tuple]], html_col: str = "html") -> DataFrame:
    """page_id, url and fields: the rows of each page's html and address, those of many pages at once."""
    schema = T.StructType([pages.schema["page_id"], T.StructField("url", T.StringType()), *fields])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for first in range(0, batch.num_rows, PAGES_AT_ONCE):
                part = batch.slice(first, PAGES_AT_ONCE)
                found = [rows_of(html, url) for html, url in zip(part.column(2).to_pylist(), part.column(1).to_pylist())]
                take = pa.array([i for i, rows in enumerate(found) for _ in rows], pa.int64())
                columns = list(zip(*[r for rows in found for r in rows])) or [[] for _ in fields]
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), *(pa.array(c, f.type) for c, f in zip(columns, list(arrow)[2:]))], schema=arrow)

    return pages.select("page_id", "url", html_col).mapInArrow(parse, schema)


# ---- the parts of an item in their order


class Units(Marks):
    """Texts, pictures and items directly in an element: (kind, inline Markdown, node), in document order."""

    def __init__(self, item: str, zones: frozenset[str]) -> None:
        super().__init__(tight=True)
        self.item, self.zones = item, zones

    def parts(self, node: int) -> Iterator[tuple[str, str | None, int | None]]:
        waiting = [iter(self.children[node])]
        while waiting:
            child = next(waiting[-1], None)
            if child is None:
                waiting.pop()
                continue
            names, tag = set(self.classes(child)), self.tags[child]
            if self.item in names:
                yield "item", None, child
            elif tag == "img":
                yield "image", None, child
            elif tag in self.media:
                continue
            elif names & self.zones:
                yield from self._line(child)
            elif self._any_below(child, lambda i: self.tags[i] == "img" or bool({self.item, *self.zones}.intersection(self.classes(i)))):
                waiting.append(iter(self.children[child]))
            else:
                yield "text", self.inline(child), None

    def _line(self, node: int) -> Iterator[tuple[str, str | None, int | None]]:
        """A zone's text, parted by the pictures in it."""
        text = ""
        for kind, value in self._leaves(node):
            if kind == "text":
                text += value
            else:
                yield "text", text, None
                yield "image", None, value
                text = ""
        yield "text", text, None

    def _leaves(self, node: int) -> Iterator[tuple[str, str | int]]:
        waiting = [self._near(node)]
        while waiting:
            part = next(waiting[-1], None)
            if part is None:
                waiting.pop()
            elif isinstance(part, str):
                yield "text", part
            elif self.tags[part] == "img":
                yield "image", part
            elif self.tags[part] in self.media or self.skipped.intersection(self.classes(part)):
                continue
            elif self._any_below(part, lambda i: self.tags[i] == "img"):
                waiting.append(self._near(part))
            else:
                yield "text", self.inline(part)

    def _near(self, node: int) -> Iterator[str | int]:
        """The pieces and elements directly in an element."""
        at = self.ranges[node][0]
        for child in self.children[node]:
            start, end = self.ranges[child]
            yield from self.pieces[at:start]
            at = end
            yield child
        yield from self.pieces[at : self.ranges[node][1]]

    def _any_below(self, node: int, test: Callable[[int], bool]) -> bool:
        return any(map(test, range(node + 1, self.last[node] + 1)))
