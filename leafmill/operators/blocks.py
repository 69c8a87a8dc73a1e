"""Blocks of pages' content areas, a row for each page or for each block; and addresses and pictures as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import text_of
from ..sources.html_nodes import NODES, SELECTED, node_arrays, node_rows
from ..sources.page_content import BASE, LAZY, PLACEHOLDER, block_arrays, content_of, selected_content


def first_attr(attrs: Column, names: tuple[str, ...]) -> Column:
    """The first of the attributes that isn't empty; empty if none."""
    return F.coalesce(*[F.nullif(F.element_at(attrs, n), F.lit("")) for n in names], F.lit(""))


def image_source(attrs: Column) -> Column:
    lazy, shown = first_attr(attrs, LAZY), first_attr(attrs, ("src",))
    return F.when((lazy != "") & ((shown == "") | F.trim(shown).rlike(f"(?i){PLACEHOLDER.pattern}")), lazy).when(shown != "", shown).otherwise(lazy)


# Fixed value: an address with dots as a part of its path.
DOTTED = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^?#]*/\.{1,2}(?:[/?#]|$)"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _without_dots(url: Column) -> Column:
    """The address with `.` and `..` taken out of its path, as they are read."""
    parts = F.slice(F.split(F.regexp_extract(url, r"^[^:]*://[^/?#]*([^?#]*)", 1), "/"), F.lit(2), F.lit(1 << 20))
    first = F.array(F.lit(""))
    folded = F.aggregate(
        parts, first, lambda acc, p: F.when(p == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)).when(p == ".", acc).otherwise(F.concat(acc, F.array(p)))
    )
    ended = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(folded, first)).otherwise(folded)
    return F.concat(F.regexp_extract(url, r"^([^:]*://[^/?#]*)", 1), F.array_join(ended, "/"), F.regexp_replace(url, r"^[^?#]*", ""))


def absolute(href: Column, base: Column) -> Column:
    """Addresses that start with a scheme, a host, a root, a query or a fragment are resolved; others against the base's folder."""
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    bare = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(F.length(bare) == F.length(origin), F.concat(origin, F.lit("/"))).otherwise(F.regexp_replace(bare, r"[^/]*$", ""))
    resolved = (
        F.when(href == "", F.lit(""))
        .when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("?"), F.concat(bare, href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, r"#.*$", ""), href))
        .otherwise(F.concat(folder, href))
    )
    return _once(resolved, lambda u: F.when(u.rlike(DOTTED), _without_dots(u)).otherwise(u))


def base_of(html: Column, url: Column) -> Column:
    """What a page's relative addresses count from: its own, or that of its base element."""
    own = F.coalesce(url, F.lit(""))
    named = html.contains("<ba") | html.contains("<BA") | html.contains("<Ba") | html.contains("<bA")  # a pattern is slow on pages without it
    return F.when(named & html.rlike(BASE), absolute(F.regexp_extract(html, BASE, 1), own)).otherwise(own)


def image_key(src: Column) -> Column:
    """A picture's address without what changes from visit to visit, on the one host that has it."""
    on_host = F.lower(F.regexp_extract(src, r"^https?://([^/?#:@]+)", 1)).rlike(r"(^|\.)mmbiz\.qpic\.cn$")
    query = F.filter(F.split(F.regexp_extract(src, r"\?([^#]*)", 1), "&"), lambda p: ~p.rlike(r"^(tp|wxfrom|wx_lazy)(=|$)") & (p != ""))
    bare = F.regexp_replace(src, r"[?#].*$", "")
    return F.when(on_host, F.concat(bare, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(F.lit("")))).otherwise(text_of(src))


BLOCK_FIELDS = "type string, level int, text string, src string, alt string, href string"


def page_areas(pages: DataFrame, url: str = "url", html_col: str = "html", keep_nodes: bool = False) -> DataFrame:
    """The columns of pages but the html, with score, n_blocks and blocks (an array) of each page's best area, null without
    one; with keep_nodes also the elements that may make blocks or areas. Columns of pages with these names are replaced. No
    rows move. Null or empty html has no area."""
    made = ("score", "n_blocks", "blocks", "nodes")
    pages = pages.drop(*[c for c in pages.columns if c in made and c != html_col])
    carried = [f for f in pages.schema.fields if f.name != html_col]
    kinds = pages.sparkSession.createDataFrame([], f"score long, n_blocks long, blocks array<struct<{BLOCK_FIELDS}>>").schema.fields
    kinds += [T.StructField("nodes", T.ArrayType(NODES))] if keep_nodes else []
    names = [f.name for f in (*carried, *kinds)]
    base_col = "_base"
    while base_col in pages.columns:
        base_col += "_"

    def areas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64)
                rows = [node_rows(html) for html in part.column(0).to_pylist()]
                found = [content_of(r, base) or (None, None, None) for r, base in zip(rows, part.column(1).to_pylist())]
                columns = [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), block_arrays([f[2] for f in found])]
                columns += [node_arrays(rows, SELECTED)] if keep_nodes else []
                yield pa.RecordBatch.from_arrays([*part.columns[2:], *columns], names=names)

    return pages.select(html_col, base_of(F.col(html_col), F.col(url)).alias(base_col), *(F.col(f.name) for f in carried)).mapInArrow(areas, T.StructType([*carried, *kinds]))


def selected_areas(pages: DataFrame, tag: Column, nth: Column, url: str = "url", page: str = "page_id") -> DataFrame:
    """page, n_selected, promoted and blocks of each page of which a person selected the nth element (from 0) of a tag.

    A selection with at most one block gives way to the page's best area, if that has over two blocks more (promoted). A page
    without such an element, or with null tag or nth, is read as if nothing was selected: n_selected is null. Pages without
    any area have null blocks.
    """
    kinds = pages.sparkSession.createDataFrame([], f"n_selected int, promoted boolean, blocks array<struct<{BLOCK_FIELDS}>>").schema.fields
    names = [page, *(f.name for f in kinds)]

    def areas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [selected_content(node_rows(html), *rest) or (None, None, None) for html, *rest in zip(*(c.to_pylist() for c in batch.columns[1:]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.bool_()), block_arrays([f[2] for f in found])], names=names)

    asked = pages.select(F.col(page), F.col("html"), base_of(F.col("html"), F.col(url)).alias("base"), tag.alias("tag"), nth.cast("int").alias("nth"))
    return asked.mapInArrow(areas, T.StructType([pages.schema[page], *kinds]))


def page_blocks(pages: DataFrame, page: str = "page_id", url: str = "url") -> DataFrame:
    """page, url, pos (from 1) and the fields of the blocks of each page's best area. Pages without one have no rows."""
    areas = page_areas(pages.select(page, url, "html"), url)
    return areas.select(page, url, F.posexplode("blocks").alias("at", "block")).select(page, url, (F.col("at") + 1).alias("pos"), "block.*")
