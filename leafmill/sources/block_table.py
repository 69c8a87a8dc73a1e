"""extract_blocks(html, url): the blocks of a page as a table function, for SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .page_content import absolute, base_href, page_content

RESULT = "pos int, type string, level int, text string, src string, alt string, href string"


class ExtractBlocks:
    """The rows that page_blocks() gives for the same page. A page without a content area, or a null one, has none."""

    def eval(self, html: str, url: str) -> Iterator[tuple]:
        own = url or ""
        href = base_href(html)
        area = page_content(html, absolute(href, own) if href else own)
        for pos, block in enumerate(area[2] if area else (), 1):
            yield (pos, *block)


def register(spark: SparkSession, name: str = "extract_blocks") -> None:
    """From now on SQL knows it: select p.page_id, b.* from pages p, lateral extract_blocks(p.html, p.url) b"""
    spark.udtf.register(name, udtf(ExtractBlocks, returnType=RESULT))
