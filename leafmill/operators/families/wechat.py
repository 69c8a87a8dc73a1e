"""Public-account articles: Markdown parted by pictures, each picture once, and how much of the source text came through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...functions.lines import plain_lists
from ...functions.text import markdown_to_text, normalize_text, utf16_length
from ...functions.urls import absolute_url
from ...sources.html_markdown import CLOSE, OPEN, markdown_rows
from ..blocks import image_key

# Attributes with a picture's address, in the order in which they count; what coverage is warned about.
SOURCES = ("data-src", "data-original", "data-original-src", "data-lazy-src", "_src", "src")
LEAST_SOURCE, LEAST_PERCENT = 80, 70
TITLES = ("activity-name", "js_text_title")


def _source(attrs: Column) -> Column:
    candidates = [F.trim(F.element_at(attrs, n)) for n in SOURCES]
    return F.coalesce(*[F.when((c != "") & ~c.startswith("data:image/svg"), c) for c in candidates])


def _cuts(markdown: DataFrame) -> DataFrame:
    """page_id, the page's counts, cut, start, picture, markdown, text: a row for each picture that stays, with the text before
    it, and one for the text after the last.

    Each text is split where pictures stand, so that its n-th piece stands before the n-th picture. A picture that is another
    one's copy, or has no address, doesn't part the text around it.
    """
    mark = f"{OPEN}[0-9]+{CLOSE}"
    page = markdown.select("page_id", "url", "n_code", "n_tables", "source_chars", F.posexplode(F.arrays_zip(F.split("markdown", mark).alias("part"), F.col("pictures").alias("attrs"))).alias("at", "p"))
    attrs = F.col("p.attrs")
    parts = page.select("page_id", "n_code", "n_tables", "source_chars", "at", "p.part", F.when(_source(attrs).isNotNull(), F.struct(absolute_url(_source(attrs), F.col("url")).alias("src"), normalize_text(attrs.getItem("alt")).alias("alt"))).alias("picture"))
    keyed = parts.withColumn("key", F.when(F.col("picture").isNotNull(), F.regexp_replace(image_key(F.col("picture.src")), "#.*$", "")))

    # the rows of a page stay together from here on
    order = Window.partitionBy("page_id").orderBy("at")
    copies = keyed.repartition("page_id").withColumn("nr", F.row_number().over(Window.partitionBy("page_id", "key").orderBy("at")))
    stays = copies.withColumn("stays", F.col("key").isNotNull() & (F.col("nr") == 1))
    cuts = stays.withColumn("cut", F.coalesce(F.sum(F.col("stays").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    runs = cuts.groupBy("page_id", "cut").agg(
        F.first("n_code").alias("n_code"), F.first("n_tables").alias("n_tables"), F.first("source_chars").alias("source_chars"), F.max(F.when(F.col("stays"), F.struct("at", "picture.src", "picture.alt", "key"))).alias("picture"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), "").alias("part"),
    )
    said = runs.select("page_id", "n_code", "n_tables", "source_chars", "cut", "picture", plain_lists(F.col("part")).alias("markdown")).withColumn("text", markdown_to_text(F.col("markdown")))
    # how many texts and pictures stand before; below a window, the texts are worked out once and not again for each condition
    before = Window.partitionBy("page_id").orderBy("cut").rowsBetween(Window.unboundedPreceding, 0)
    return said.withColumn("n_texts", F.count_if((F.col("markdown") != "") & (F.col("text") != "")).over(before)).withColumn("n_pictures", F.count("picture").over(before)).withColumn("says", (F.col("markdown") != "") & (F.col("text") != ""))


def wechat_blocks(pages: DataFrame) -> DataFrame:
    """page_id, pos, type, text, markdown, src, alt, source_id, source_order of each page with the family's content element."""
    return blocks_of(markdown_rows(pages.select("page_id", "url", "html")))


def blocks_of(markdown: DataFrame) -> DataFrame:
    """The same from the pages' Markdown with its pictures."""
    none = F.lit(None).cast("string")
    at = F.col("n_texts") + F.col("n_pictures") - F.col("picture").isNotNull().cast("int")
    block = lambda pos, kind, text, markdown, src, alt, source_id: F.struct(pos.cast("int").alias("pos"), F.lit(kind).alias("type"), text.alias("text"), markdown.alias("markdown"), src.alias("src"), alt.alias("alt"), source_id.alias("source_id"))
    said = block(at, "paragraph", F.col("text"), F.col("markdown"), none, none, F.concat(F.lit("wechat:text:"), F.col("n_texts").cast("string")))
    shown = block(at + 1, "image", none, none, F.col("picture.src"), F.col("picture.alt"), F.concat(F.lit("wechat:image:"), "picture.key"))
    both = _cuts(markdown).select("page_id", F.inline(F.filter(F.array(F.when(F.col("says"), said), F.when(F.col("picture").isNotNull(), shown)), lambda b: b.isNotNull())))
    return both.withColumn("source_order", (F.col("pos") - 1).cast("double"))


def page_coverage(pages: DataFrame) -> DataFrame:
    """wechat_coverage() of pages and their own blocks, from one parse."""
    chars = F.sum(F.when(F.col("says"), utf16_length(F.col("text"))))
    found = _cuts(markdown_rows(pages.select("page_id", "url", "html"))).groupBy("page_id").agg(
        F.first("source_chars").alias("source_chars"), F.first("n_code").alias("code_blocks"), F.first("n_tables").alias("tables"), F.coalesce(chars, F.lit(0)).alias("exported_chars"), F.count("picture").alias("images")
    )
    return _rated(found.select("page_id", "source_chars", "code_blocks", "tables", "exported_chars", "images"))


def wechat_coverage(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """page_id, source_chars, exported_chars, percent, images, code_blocks, tables, warn of each page."""
    source = markdown_rows(pages.select("page_id", "url", "html")).select("page_id", "source_chars", F.col("n_code").alias("code_blocks"), F.col("n_tables").alias("tables"))
    out = blocks.groupBy("page_id").agg(F.coalesce(F.sum(F.when(F.col("type") != "image", utf16_length(markdown_to_text(F.col("markdown"))))), F.lit(0)).alias("exported_chars"), F.count_if(F.col("type") == "image").alias("images"))
    return _rated(source.join(out, "page_id", "left").fillna(0, ["exported_chars", "images"]))


def _rated(both: DataFrame) -> DataFrame:
    percent = F.when(F.col("source_chars") == 0, 100).otherwise(F.round(100 * F.col("exported_chars") / F.col("source_chars"))).cast("long")
    return both.withColumn("percent", percent).withColumn("warn", (F.col("source_chars") >= LEAST_SOURCE) & (100 * F.col("exported_chars") < LEAST_PERCENT * F.col("source_chars")))
