"""The content of public-account pages as Markdown with marks where pictures stand.

Markdown nests as elements do, so it is made where a page is parsed. The rules are those that HTML-to-Markdown converters
document: ATX headings, `-` bullets, fenced code, inline links, tables with the first row as head.
"""

from __future__ import annotations

import re
from collections.abc import Generator, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..operators.merge import squeeze
from .html_marks import Marks, unrolled

# What isn't content, and what hides an element.
NOISE = frozenset("qr_code_pc reward_area rich_media_tool code-snippet__line-index".split())
HIDDEN = re.compile(r"(?:^|;\s*)(?:display\s*:\s*none|visibility\s*:\s*hidden|opacity\s*:\s*0)(?:\s*;|\s*$)", re.I)
LINE_COUNTER = re.compile(r"^[ce]?ounter\(line", re.I)
FLOWING = frozenset("a abbr b bdi bdo cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time u var".split())
FORMATS = {"strong": "**", "b": "**", "em": "*", "i": "*", "del": "~", "s": "~", "strike": "~"}

#: Around the number of a picture's element.
OPEN, CLOSE = chr(0xE000), chr(0xE001)

#: source_chars: UTF-16 units of the source's text. pictures: the attributes of the element behind each mark of the Markdown, in their order; null where a mark is none's.
ROW = [
    T.StructField("markdown", T.StringType()), T.StructField("source_chars", T.LongType()), T.StructField("n_code", T.IntegerType()), T.StructField("n_tables", T.IntegerType()),
    T.StructField("pictures", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
]
_KINDS = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.map_(pa.string(), pa.string())))
_MARK = re.compile(f"{OPEN}([0-9]+){CLOSE}")


_ESCAPED, _LINE_MARK, _RUN = re.compile(r"([\\*_`\[\]])"), re.compile(r"^(#{1,6} |[->]|\+ |=+|~~~|\d+(?=\. ))"), re.compile(r"[ \t\r\n]+")


def _one_line(text: str) -> str:
    return _RUN.sub(" ", text) if "  " in text or "\n" in text or "\t" in text or "\r" in text else text


def escaped(text: str) -> str:
    out = _ESCAPED.sub(r"\\\1", text) if _ESCAPED.search(text) else text
    return _LINE_MARK.sub(lambda m: m[1] + "\\" if m[1].isdigit() else "\\" + m[1], out)


class Page(Marks):
    def __init__(self) -> None:
        super().__init__(tight=True)
        self.n_code = 0

    def gone(self, node: int) -> bool:
        attrs = self.attrs[node]
        if not attrs and self.tags[node] not in FORMATS:
            return False
        hidden = "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or bool(HIDDEN.search(attrs.get("style", "")))
        empty = self.tags[node] in FORMATS and not squeeze(self.text(node)) and not self._below(node, "img")
        return hidden or empty or bool(NOISE.intersection(self.classes(node)))

    def _below(self, node: int, tag: str) -> list[int]:
        return [i for i in range(node + 1, self.last[node] + 1) if self.tags[i] == tag]

    def contents(self, node: int) -> Iterator[str | int]:
        at = self.ranges[node][0]
        for child in self.children[node]:
            start, end = self.ranges[child]
            yield from self.pieces[at:start]
            at = end
            if not self.gone(child):
                yield child
        yield from self.pieces[at : self.ranges[node][1]]

    def flow(self, node: int, cell: bool = False) -> str:
        """Markdown of what stands in lines; in a cell blocks and breaks are spaces."""
        return unrolled(self._flow(node, cell))

    def _flow(self, node: int, cell: bool) -> Generator:
        out = ""
        for part in self.contents(node):
            if isinstance(part, str):
                out += escaped(_one_line(part))
                continue
            tag = self.tags[part]
            if tag == "br":
                out += " " if cell else "\n"
            elif tag == "img":
                out += f"\n\n{OPEN}{part}{CLOSE}\n\n"
            elif tag == "code":
                out += f"`{self.text(part)}`" if self.text(part).strip() else ""
            else:
                inner = yield self._flow(part, cell)
                bare = inner.strip()
                if tag == "a" and bare and self.attrs[part].get("href"):
                    inner = inner.replace(bare, f"[{bare}]({self.attrs[part]['href']})", 1)
                elif tag in FORMATS and bare:
                    inner = inner.replace(bare, FORMATS[tag] + bare + FORMATS[tag], 1)
                out += f" {inner} " if cell and tag not in FLOWING else inner
        return out

    def blocks(self, node: int) -> list[str]:
        return unrolled(self._blocks(node))

    def _blocks(self, node: int) -> Generator:
        out, line = [], ""

        def close() -> None:
            nonlocal line
            text = "\n".join(x.strip(" ") for x in line.split("\n")).strip()
            if text:
                out.append(text)
            line = ""

        for part in self.contents(node):
            if isinstance(part, str):
                line += escaped(_one_line(part))
            elif self.tags[part] in FLOWING and not self._holds_blocks(part) or self.tags[part] in ("br", "img"):
                line += self._single(part)
            else:
                close()
                out += yield self._block(part)
        close()
        return out

    def _single(self, node: int) -> str:
        holder = len(self.tags)
        self.children.append([node])
        self.ranges.append(self.ranges[node])
        try:
            return self.flow(holder)
        finally:
            self.children.pop()
            self.ranges.pop()

    def _holds_blocks(self, node: int) -> bool:
        return any(self.tags[i] not in FLOWING and self.tags[i] not in ("br", "img") for i in range(node + 1, self.last[node] + 1))

    def _block(self, node: int) -> Generator:
        tag = self.tags[node]
        if "code-snippet__fix" in self.classes(node) or tag == "pre":
            return self._code(node)
        if re.fullmatch("h[1-6]", tag):
            text = squeeze(self.flow(node))
            return [f"{'#' * int(tag[1])} {text}"] if text else []
        if tag == "hr":
            return ["---"]
        if tag == "blockquote":
            inner = "\n\n".join((yield self._blocks(node)))
            return ["\n".join(f"> {x}".rstrip() for x in inner.split("\n"))] if inner else []
        if tag in ("ul", "ol"):
            start = self.attrs[node].get("start", "1")
            number = int(start) if start.isdigit() else 1
            lines = []
            for item in (c for c in self.children[node] if self.tags[c] == "li" and not self.gone(c)):
                mark = "- " if tag == "ul" else f"{number + len(lines)}. "
                inner = yield self._blocks(item)
                joined = "\n".join(inner) if len(inner) < 2 or all(re.match(r"(?:- |\d+\. )", x) for x in inner[1:]) else "\n\n".join(inner)
                lines.append(mark + joined.replace("\n", "\n    "))
            return ["\n".join(lines)] if lines else []
        if tag == "table":
            rows = [[squeeze(self.flow(c, cell=True)).replace("|", "\\|") for c in self.children[r] if self.tags[c] in ("td", "th")] for r in self._below(node, "tr")]
            rows = [r for r in rows if r]
            if not rows:
                return []
            width = max(map(len, rows))
            rows = [r + [""] * (width - len(r)) for r in rows]
            return ["\n".join("| " + " | ".join(r) + " |" for r in [rows[0], ["---"] * width, *rows[1:]])]
        return (yield self._blocks(node))

    def _code(self, node: int) -> list[str]:
        pre = node if self.tags[node] == "pre" else next(iter(self._below(node, "pre")), node)
        lines = [self.text(c) for c in self._below(node, "code")]
        lines = [x for x in lines if not LINE_COUNTER.match(x.strip())]
        code = re.sub(r"\r\n?", "\n", "\n".join(lines) if lines else self.text(pre)).strip("\n")
        if not code.strip():
            return []
        self.n_code += 1
        named = re.search(r"(?:language|lang)-([a-z0-9_+#.-]+)", self.attrs[pre].get("class", ""), re.I)
        language = self.attrs[pre].get("data-lang", "").strip() or (named[1] if named else "")
        fence = "`" * max([3, *(len(x) + 1 for x in re.findall(r"^`{3,}", code, re.M))])
        return [f"{fence}{language}\n{code}\n{fence}"]

    def source_text(self, node: int) -> str:
        return unrolled(self._source_text(node))

    def _source_text(self, node: int) -> Generator:
        parts = []
        for p in self.contents(node):
            parts.append(p if isinstance(p, str) else "\n" if self.tags[p] == "br" else (yield self._source_text(p)))
        return " ".join(parts)


def page_markdown(html: str | None) -> tuple | None:
    page = Page()
    page.finish(html)
    root = next((i for i, a in enumerate(page.attrs) if a.get("id") == "js_content"), None)
    if root is None:
        return None
    return tree_markdown(page, root)


def tree_markdown(page: Page, root: int) -> tuple:
    """The values of ROW for the content below root."""
    text = "\n\n".join(page.blocks(root))
    nodes = [int(n) if len(n) < 10 else -1 for n in _MARK.findall(text)]
    pictures = [list(page.attrs[n].items()) if 0 <= n < len(page.tags) and page.tags[n] == "img" else None for n in nodes]
    source = squeeze(page.source_text(root))
    units = len(source) if source.isascii() else len(source.encode("utf-16-le", "surrogatepass")) // 2
    return text, units, page.n_code, len(page._below(root, "table")), pictures


def markdown_rows(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """page_id, url and the columns of ROW of each page that has the content's element."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64)
                made = [page_markdown(h) for h in part.column(2).to_pylist()]
                keep = pa.array([i for i, m in enumerate(made) if m is not None], pa.int64())
                columns = list(zip(*[m for m in made if m is not None])) or [[]] * len(ROW)
                yield pa.RecordBatch.from_arrays([part.column(0).take(keep), part.column(1).take(keep), *(pa.array(c, k) for c, k in zip(columns, _KINDS))], names=["page_id", "url", *(f.name for f in ROW)])

    return pages.select("page_id", "url", html_col).mapInArrow(convert, T.StructType([pages.schema["page_id"], pages.schema["url"], *ROW]))
