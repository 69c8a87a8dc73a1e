"""Pages of all site families, each parsed once for the reader that takes it.

The address names a family; the page must also have that family's root, else it is read as any page. One pass parses, tests
the root, finds the title and writes what the reader needs as rows of several kinds into one table, parted by family and kind.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.urls import site_family
from ..operators.merge import squeeze
from . import block_rows, html_markdown, item_rows
from .html_marks import PAGES_AT_ONCE, Marks, Units
from .html_nodes import node_rows
from .page_content import content_of
from .shared import shared_path

# What the families' roots are, and where their titles stand, in the order in which they count.
WECHAT_ROOT, WECHAT_TITLES = "js_content", (("id", "activity-name"), ("id", "js_text_title"), ("class", "rich_media_title"))
FEISHU_ROOT, FEISHU_TITLES = "docx-page-block", (("tag", "h1"), ("class", "docx-title"))
COURSE_ROOT, ITEM_CONTENT, ITEM = "vc-course-content", "feishu-doc-content", "vc-doc-item"
SITE_SUFFIX = re.compile(r"\s*[-|\uff5c]\s*\u751f\u8d22\u6709\u672f.*$", re.I)

#: The columns of each kind of row, beside page_id, url, family and kind.
KINDS = {
    "page": [T.StructField("title", T.StringType())],
    "article": [T.StructField(f"article_{f.name}", f.dataType) for f in item_rows.ARTICLE_FIELDS],
    "markdown": html_markdown.ROW,
    "item": [T.StructField(f"item_{f.name}", f.dataType) for f in item_rows.COURSE_FIELDS],
    "top": [T.StructField(f"top_{f.name}", f.dataType) for f in block_rows.FIELDS],
    "block": [T.StructField("pos", T.IntegerType()), *(T.StructField(f"block_{n}", t) for n, t in (("type", T.StringType()), ("level", T.IntegerType()), ("text", T.StringType()), ("src", T.StringType()), ("alt", T.StringType()), ("href", T.StringType())))],
}
COLUMNS = [f for fields in KINDS.values() for f in fields]


class Reader:
    """How pages of one family are parsed: the tree, the root, the title and the rows."""

    def tree(self) -> Marks:
        return Marks(tight=True)

    def root(self, tree: Marks) -> int | None:
        raise NotImplementedError

    def title(self, tree: Marks, root: int) -> str:
        return ""

    def rows(self, tree: Marks, root: int, url: str | None) -> Iterator[tuple[str, list[tuple]]]:
        raise NotImplementedError


def _found(tree: Marks, tests: tuple, first: int = 0, last: int | None = None) -> Iterator[str]:
    """The texts of the elements that pass, by test and then by place."""
    last = len(tree.tags) - 1 if last is None else last
    for kind, value in tests:
        for i in range(first, last + 1):
            if tree.tags[i] == value if kind == "tag" else value in tree.classes(i) if kind == "class" else tree.attrs[i].get(kind) == value:
                yield squeeze(tree.text(i))


def _holds(tree: Marks, node: int, *names: str) -> bool:
    return all(any(name in tree.classes(i) for i in range(node + 1, tree.last[node] + 1)) for name in names)


class WechatReader(Reader):
    def tree(self) -> Marks:
        return html_markdown.Page()

    def root(self, tree: Marks) -> int | None:
        return next((i for i, a in enumerate(tree.attrs) if a.get("id") == WECHAT_ROOT), None)

    def title(self, tree: Marks, root: int) -> str:
        # each place counts with its first element
        for test in WECHAT_TITLES:
            if text := next(_found(tree, (test,)), ""):
                return text
        return squeeze(next((a.get("content") for a in tree.attrs if a.get("property") == "og:title"), ""))

    def rows(self, tree: Marks, root: int, url: str | None) -> Iterator[tuple[str, list[tuple]]]:
        yield "markdown", [html_markdown.tree_markdown(tree, root)]


class FeishuReader(Reader):
    def tree(self) -> Marks:
        return Marks(tight=False)

    def root(self, tree: Marks) -> int | None:
        return next((i for i in range(len(tree.tags)) if FEISHU_ROOT in tree.classes(i)), None)

    def title(self, tree: Marks, root: int) -> str:
        return next(_found(tree, FEISHU_TITLES, root + 1, tree.last[root]), "")

    def rows(self, tree: Marks, root: int, url: str | None) -> Iterator[tuple[str, list[tuple]]]:
        yield "top", block_rows.block_rows(tree)


class CourseReader(Reader):
    def root(self, tree: Marks) -> int | None:
        first = next((i for i, tag in enumerate(tree.tags) if tag == "main" or COURSE_ROOT in tree.classes(i)), None)
        return first if first is not None and _holds(tree, first, ITEM_CONTENT, ITEM) else None

    def title(self, tree: Marks, root: int) -> str:
        return next(_found(tree, (("tag", "h1"),), root + 1, tree.last[root]), "")

    def rows(self, tree: Marks, root: int, url: str | None) -> Iterator[tuple[str, list[tuple]]]:
        yield "item", item_rows.course_rows(tree, url)


class ArticleReader(Reader):
    def tree(self) -> Marks:
        return Units(ITEM, frozenset((item_rows.ZONE, item_rows.BULLET)))

    def root(self, tree: Marks) -> int | None:
        names = [set(tree.classes(i)) for i in range(len(tree.tags))]
        return 0 if any(ITEM_CONTENT in n for n in names) and any(ITEM in n for n in names) else None

    def title(self, tree: Marks, root: int) -> str:
        return item_rows.article_title(tree)

    def rows(self, tree: Marks, root: int, url: str | None) -> Iterator[tuple[str, list[tuple]]]:
        yield "article", item_rows.article_rows(tree)


READERS = {"wechat": WechatReader(), "scys-article": ArticleReader(), "scys": CourseReader(), "feishu": FeishuReader()}


def _page(family: str, html: str | None, url: str | None, base: str) -> tuple[str, str, list[tuple[str, list[tuple]]]]:
    """The family that reads the page, its title there, and rows by kind."""
    reader = READERS.get(family)
    if reader:
        tree = reader.tree()
        tree.finish(html)
        root = reader.root(tree)
        if root is not None:
            return family, reader.title(tree, root), list(reader.rows(tree, root, url))
    area = content_of(node_rows(html), base)
    return "generic", "", [("block", [(n, *b) for n, b in enumerate(area[2], 1)])] if area else []


class SitePages:
    """The parsed pages: a table of rows by family and kind."""

    def __init__(self, stored: DataFrame) -> None:
        self.stored = stored

    def rows(self, family: str, kind: str) -> DataFrame:
        names = [F.col(f.name).alias(f.name.removeprefix(f"{kind}_")) for f in KINDS[kind]]
        return self.stored.where((F.col("family") == family) & (F.col("kind") == kind)).select("page_id", "url", *names)

    def titles(self) -> DataFrame:
        """page_id, family, title of each page: that of its reader, else the document's, else Web Clip."""
        return self.stored.where("kind = 'page'").select("page_id", "family", "title")


def parse_pages(pages: DataFrame, title: Column, base: Column) -> SitePages:
    """pages: page_id, url, html. title is what the document calls itself, base what its relative addresses count from. Null
    or empty html is a page without rows of its own, read as any page."""
    spark = pages.sparkSession
    page_id = pages.schema["page_id"]
    schema = T.StructType([page_id, T.StructField("url", T.StringType()), T.StructField("family", T.StringType()), T.StructField("kind", T.StringType()), *COLUMNS])

    def batch_of(arrow: pa.Schema, part: pa.RecordBatch, family: str, kind: str, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
        given, take = dict(zip((f.name for f in KINDS[kind]), zip(*rows))), pa.array(at, pa.int64())
        columns = [part.column(0).take(take), part.column(1).take(take), pa.array([family] * len(rows)), pa.array([kind] * len(rows))]
        columns += [pa.array(given[f.name], f.type) if f.name in given else pa.nulls(len(rows), f.type) for f in list(arrow)[4:]]
        return pa.RecordBatch.from_arrays(columns, schema=arrow)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for first in range(0, batch.num_rows, PAGES_AT_ONCE):
                part, kinds = batch.slice(first, PAGES_AT_ONCE), {}
                for i, (url, family, html, base, named) in enumerate(zip(*(c.to_pylist() for c in part.columns[1:]))):
                    family, title, found = _page(family, html, url, base)
                    if family == "scys-article" and not title:
                        title = SITE_SUFFIX.sub("", named or "")
                    for kind, rows in (("page", [(title or named or "Web Clip",)]), *found):
                        at, every = kinds.setdefault((family, kind), ([], []))
                        at += [i] * len(rows)
                        every += rows
                for (family, kind), (at, rows) in kinds.items():
                    if rows:
                        yield batch_of(arrow, part, family, kind, at, rows)

    asked = pages.select("page_id", F.col("url").cast("string").alias("url"), site_family(F.col("url")).alias("family"), "html", base.alias("base"), title.alias("named"))
    path = shared_path(spark, "site-pages")
    asked.mapInArrow(parse, schema).write.partitionBy("family", "kind").parquet(path)
    return SitePages(spark.read.schema(schema).parquet(path))
