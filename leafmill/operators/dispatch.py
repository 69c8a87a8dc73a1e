"""Pages of several sites in one table, each read by the reader of its site."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.site_pages import SitePages, parse_pages
from .blocks import base_of
from .families import article, course, feishu, wechat

#: The columns of the blocks of all readers, those that a reader doesn't have are null.
BLOCKS = "type string, level int, text string, markdown string, ordered boolean, depth int, language string, src string, alt string, href string, rows array<array<string>>, source_id string"


def document_title(html):
    """What the document calls itself, empty if it doesn't."""
    return X.normalize_text(X.decoded(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def parse(pages: DataFrame) -> SitePages:
    return parse_pages(pages.select("page_id", "url", "html"), document_title(F.col("html")), base_of(F.col("html"), F.col("url")))


def site_blocks(parsed: SitePages) -> DataFrame:
    """page_id, family, pos and BLOCKS of all pages: the first reader whose address and root a page has takes it, in the order
    of urls.FAMILIES, else the reader of any page."""
    by_family = {
        "wechat": wechat.blocks_of(parsed.rows("wechat", "markdown")),
        "scys-article": article.blocks_of(parsed.rows("scys-article", "article")),
        "scys": course.blocks_of(parsed.rows("scys", "item")),
        "feishu": feishu.blocks_of(parsed.rows("feishu", "top")),
        "generic": parsed.rows("generic", "block"),
    }
    fields = [f.split(" ") for f in BLOCKS.split(", ")]

    def tagged(family: str, found: DataFrame) -> DataFrame:
        columns = [(F.col(n) if n in found.columns else F.lit(None)).cast(t).alias(n) for n, t in fields]
        return found.select("page_id", F.lit(family).alias("family"), F.col("pos").cast("int").alias("pos"), *columns)

    return reduce(DataFrame.unionByName, (tagged(f, d) for f, d in by_family.items()))


def read_pages(pages: DataFrame) -> DataFrame:
    """site_blocks() of pages (page_id, url, html), each parsed once. Pages with null or empty html have no blocks."""
    return site_blocks(parse(pages))
