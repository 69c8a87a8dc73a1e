"""Long articles of the course family: items whose texts, pictures and items are read in their order, after an opening text.

Every item comes with its parts and with what the items around it say of it; a page's rows move once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...functions.text import code_language, heading_level, inline_markdown_to_text, list_depth, normalize_indented_code, normalize_inline_markdown, normalize_text
from ...sources.html_marks import page_rows
from ...sources.item_rows import ARTICLE_FIELDS, page_article_rows
from ..blocks import absolute, image_source
from ..islands import NUMBER_ONLY, runs
from .course import body_picture, grid_rows, item_text, numbered

# Fixed value: what numbers the lines of an opening text.
NUMBERED = r"^(?:\d+|[\x{4E00}\x{4E8C}\x{4E09}\x{56DB}\x{4E94}\x{516D}\x{4E03}\x{516B}\x{4E5D}\x{5341}\x{767E}]+)[\x{3001}.\x{FF0E}]\s*(.+)$"
PART = "struct<start:int,at:int,kind:string,inline:string,attrs:map<string,string>>"
COLUMNS = ("type", "level", "text", "markdown", "ordered", "depth", "language", "src", "alt", "rows")


def article_blocks(pages: DataFrame) -> DataFrame:
    """page_id, pos, type, level, text, markdown, ordered, depth, language, src, alt, rows of each article page.

    pages: page_id, url, html. Neighbouring list items become one paragraph, and what is in a quote, up to pictures, code
    and grids, one quote.
    """
    return blocks_of(page_rows(pages, ARTICLE_FIELDS, page_article_rows))


def blocks_of(rows: DataFrame) -> DataFrame:
    """The same from the rows of the pages' items, opening texts and headings."""
    # a page's rows stay together from here on; they are in the order (place that they follow, number of the part)
    ranked = _lines(rows).repartition("page_id").withColumn("pos", F.row_number().over(Window.partitionBy("page_id").orderBy("start", "at")))
    return _compact(_quotes(_numbers(ranked, "quote")))


def _parts(rows: DataFrame) -> DataFrame:
    """The rows' parts, one in each row: of an item that is whole or says nothing by its parts, itself."""
    part = lambda at, kind, inline: F.struct(F.col("pre").alias("start"), at.cast("int").alias("at"), F.lit(kind).alias("kind"), inline.alias("inline"), F.lit(None).cast("map<string,string>").alias("attrs")).cast(PART)
    none, first = F.lit(None).cast("string"), F.lit(-1)
    # an opening text has a text of its own if it has more than its parts
    held = F.aggregate(F.filter("parts", lambda p: p["kind"] == "text"), F.lit(0), lambda n, p: n + F.length(normalize_text(p["inline"])))
    plain = ~F.col("pictured") & (F.length(inline_markdown_to_text(F.col("inline"))) > held)
    lines = F.transform(F.split(normalize_inline_markdown(F.col("inline")), "(?i)<br>"), lambda line, at: part(at, "opening", line))
    found = (
        F.when(F.col("kind") == "heading", F.array(part(first, "heading", F.col("inline")))).when((F.col("kind") == "opening") & plain, lines).when(F.col("kind") == "opening", F.col("parts").cast(f"array<{PART}>"))
        .when(F.col("whole"), F.array(part(first, "whole", F.when(F.col("level").isNotNull(), item_text(F.col("shown")))))).when(F.col("silent"), F.array(part(first, "text", item_text(F.col("shown"))))).otherwise(F.col("parts").cast(f"array<{PART}>"))
    )
    level = F.coalesce("level", heading_level(F.col("classes")))
    code = F.coalesce(F.when(F.col("whole") & F.col("code").isNotNull(), normalize_indented_code(F.col("code"))), F.lit(""))
    known = rows.withColumn("level", level).select("*", code.alias("own_code"), F.when(F.col("whole"), grid_rows()).alias("own_rows"), numbered().alias("numbered"))
    return known.select("page_id", "url", "quote", F.col("depth").alias("own_depth"), F.coalesce("is_list", F.lit(False)).alias("is_list"), "numbered", F.col("level").alias("own_level"), "own_code", F.col("language").alias("own_language"), "own_rows", F.inline(found))


def _lines(rows: DataFrame) -> DataFrame:
    """page_id, quote, start, at and COLUMNS of what each part shows."""
    parts = _parts(rows)
    kind, line = F.col("kind"), normalize_inline_markdown(F.col("inline"))
    listed = (kind == "text") & F.col("is_list")
    counted = (kind == "opening") & line.rlike(NUMBERED)
    headed, coded = F.col("own_level").isNotNull(), F.col("own_code") != ""
    solid = kind == "whole"
    md = F.when(kind == "text", line).when(counted, F.regexp_extract(line, NUMBERED, 1)).when(kind == "opening", line)
    made = parts.select("page_id", "url", "quote", "start", "at", "kind", "attrs", "inline", "is_list", "numbered", "own_depth", "own_level", "own_code", "own_language", "own_rows", md.alias("md"), counted.alias("counted"))
    text = F.when(kind.isin("text", "opening"), inline_markdown_to_text(F.col("md"))).when(kind == "heading", normalize_text(F.col("inline"))).when(solid & headed, inline_markdown_to_text(F.col("inline"))).when(solid & coded, F.col("own_code"))
    block = F.struct(
        F.when(listed | F.col("counted"), "listItem").when(kind.isin("text", "opening"), "paragraph").when(kind == "image", "image").when((kind == "heading") | headed, "heading").when(coded, "code").otherwise("table").alias("type"),
        F.when((kind == "heading") | (solid & headed), F.col("own_level")).alias("level"), text.alias("text"), F.col("md").alias("markdown"), F.when(listed, F.col("numbered")).when(F.col("counted"), True).alias("ordered"),
        F.when(listed, F.col("own_depth")).when(F.col("counted"), 0).alias("depth"), F.when(solid & ~headed & coded, F.coalesce(code_language(F.col("own_language")), F.lit(""))).alias("language"),
        F.when(kind == "image", absolute(image_source(F.col("attrs")), F.coalesce("url", F.lit("")))).alias("src"), F.when(kind == "image", normalize_text(F.col("attrs").getItem("alt"))).alias("alt"),
        F.when(solid & ~headed & ~coded, F.col("own_rows")).alias("rows"), ((kind != "image") | F.coalesce(body_picture(F.col("attrs")), F.lit(False))).alias("_body"),
    )
    # as a generator's, the texts are worked out once and not again for the condition
    shown = made.select("page_id", "quote", "start", "at", F.inline(F.array(block)))
    return shown.where("_body and (type in ('table', 'image') or coalesce(text, '') <> '')").drop("_body")


def _numbers(rows: DataFrame, within: str) -> DataFrame:
    """A list item that is only a number goes, and numbers the item after it, in the same quote or outside of all."""
    order = Window.partitionBy("page_id", F.coalesce(within, F.lit(-1))).orderBy("pos")
    number = F.coalesce((F.col("type") == "listItem") & F.col("text").rlike(NUMBER_ONLY), F.lit(False))
    plain = F.coalesce((F.col("type") == "listItem") & ~F.col("text").rlike(NUMBER_ONLY), F.lit(False))
    beside = F.coalesce(F.lead("pos").over(order) == F.col("pos") + 1, F.lit(False))
    before = F.coalesce(F.lag("pos").over(order) == F.col("pos") - 1, F.lit(False))
    seen = rows.select("*", number.alias("_n"), (F.lag(number, 1, False).over(order) & before & plain).alias("_after"), (F.lead(plain, 1, False).over(order) & beside).alias("_next"), F.lag("depth").over(order).alias("_d"))
    return seen.withColumn("ordered", F.when(F.col("_after"), True).otherwise(F.col("ordered"))).withColumn("depth", F.when(F.col("_after"), F.least(list_depth(F.col("depth")), list_depth(F.col("_d")))).otherwise(F.col("depth"))).where("not (_n and _next)").drop("_n", "_after", "_next", "_d")


def _line_of():
    item = F.concat(F.repeat(F.lit("    "), list_depth(F.col("depth"))), F.when(F.col("ordered"), "1. ").otherwise("- "), F.coalesce(F.nullif("markdown", F.lit("")), F.col("text")))
    return F.when(F.col("type") == "listItem", item).when(F.col("type") == "heading", F.concat(F.repeat(F.lit("#"), F.least(F.greatest(F.col("level"), F.lit(1)), F.lit(6))), F.lit(" "), "text")).otherwise(F.coalesce(F.nullif("markdown", F.lit("")), F.col("text"), F.lit("")))


def _folded(rows: DataFrame, keys: list[str], many: Column, kind: str) -> DataFrame:
    """The rows of the same keys as one block of their lines, at the place of the first, where many holds; others as they are."""
    lines = F.transform(F.array_sort(F.collect_list(F.when(F.col("_joins"), F.struct("pos", _line_of().alias("line"))))), lambda x: x["line"])
    grouped = rows.groupBy(*keys).agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("_n"), F.bool_or("_joins").alias("_joins"), F.array_join(F.filter(lines, lambda x: x != ""), "\n").alias("_lines"), F.min_by(F.struct(*COLUMNS), "pos").alias("_own"))
    folded = grouped.withColumn("_many", many)
    dtypes = dict(rows.dtypes)
    given = {"type": F.lit(kind), "text": inline_markdown_to_text(F.col("_lines")), "markdown": F.col("_lines")}
    full = folded.select("*", F.inline(F.array(F.struct(*[F.when(F.col("_many"), given.get(n, F.lit(None).cast(dtypes[n]))).otherwise(F.col("_own")[n]).alias(n) for n in COLUMNS]))))
    return full.where("not _many or text <> ''").select("page_id", "pos", *COLUMNS)


def _quotes(rows: DataFrame) -> DataFrame:
    """What is in a quote, up to pictures, code and grids, as one quote."""
    apart = F.col("type").isin("image", "code", "table")
    order = Window.partitionBy("page_id", "quote").orderBy("pos")
    starts = apart | F.coalesce(F.lag(apart).over(order), F.lit(True))
    run = F.sum(F.col("_start").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    joins = F.col("quote").isNotNull() & ~apart
    numbered_runs = rows.withColumn("_start", starts).withColumn("_run", F.when(F.col("quote").isNotNull(), run).otherwise(-F.col("pos"))).withColumn("_joins", joins)
    return _folded(numbered_runs, ["page_id", "quote", "_run"], F.col("_joins"), "quote")


def _compact(rows: DataFrame) -> DataFrame:
    """Each block once, and neighbouring list items as one paragraph."""
    key = F.struct("type", F.when(F.col("type") == "image", F.concat_ws(" ", "pos")).otherwise(F.concat_ws("\x1f", F.coalesce(F.col("level").cast("string"), F.lit("")), F.coalesce("text", F.lit("")), F.coalesce("markdown", F.lit("")), F.coalesce(F.col("ordered").cast("string"), F.lit("false")), F.coalesce(F.col("depth").cast("string"), F.lit("")), F.coalesce(F.to_json("rows"), F.lit("")))))
    firsts = rows.withColumn("nr", F.row_number().over(Window.partitionBy("page_id", key).orderBy("pos"))).where("nr = 1").drop("nr")
    dense = firsts.withColumn("pos", F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))).withColumn("loose", F.lit(None).cast("int"))
    grouped = runs(_numbers(dense, "loose").drop("loose"), F.col("type") == "listItem", "page_id", "pos").withColumn("_joins", F.col("type") == "listItem")
    out = _folded(grouped, ["page_id", "run"], F.col("_joins") & (F.col("_n") > 1), "paragraph")
    return out.select("page_id", F.row_number().over(Window.partitionBy("page_id").orderBy("pos")).alias("pos"), *COLUMNS)
