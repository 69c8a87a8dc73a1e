"""Documents of nested blocks, each with an id: headings, lists, quotes, tables, code, pictures and text.

Every block comes with what belongs to it; what it shows, and which of several with one id counts, is decided here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...functions.text import ANY_SPACE, inline_markdown_to_text, normalize_code, normalize_text
from ...sources.block_rows import BULLET, CODE, FIELDS, IMAGE, ORDERED, QUOTE, TABLE, TEXT, page_block_rows
from ...sources.html_marks import page_rows
from ..blocks import absolute, image_source

#: What a block may show: the place of the block, the number of the part and the fields of a block.
ITEM = "struct<block:int,part:int,several:boolean,type:string,lines:array<string>,code:string,src:string,alt:string,rows:array<array<string>>,record:string,block_id:string>"


def _has(classes: Column, *names: str) -> Column:
    return F.arrays_overlap(classes, F.array(*map(F.lit, names)))


def _lines(parts: Column) -> Column:
    """The lines that have a text, their white space as single spaces."""
    return F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, f"{ANY_SPACE}+", " "))), lambda p: p != "")


def _item(block: Column, kind: str | Column, record: Column, block_id: Column, part: Column | None = None, several: Column | None = None, **fields: Column) -> Column:
    given = {"block": block, "part": F.lit(0) if part is None else part, "several": F.lit(False) if several is None else several, "type": F.lit(kind) if isinstance(kind, str) else kind, "record": record, "block_id": block_id} | fields
    return F.struct(*[given.get(n, F.lit(None)).alias(n) for n in ("block", "part", "several", "type", "lines", "code", "src", "alt", "rows", "record", "block_id")]).cast(ITEM)


def _pictures(block: Column, pictures: Column, record: Column, block_id: Column) -> Column:
    """Items of the distinct pictures of a block."""
    found = F.transform(pictures, lambda a: F.struct(absolute(image_source(a), F.coalesce("url", F.lit(""))).alias("src"), normalize_text(a["alt"]).alias("alt")))
    distinct = F.array_distinct(F.filter(found, lambda p: p["src"] != ""))
    items = lambda every: F.transform(every, lambda p, k: _item(block, "image", record, block_id, k, F.size(every) > 1, src=p["src"], alt=p["alt"]))
    return F.flatten(F.transform(F.array(distinct), items))


def _cell(c: Column) -> Column:
    """A cell has its blocks' lines, or its own, or its plain text."""
    joined = lambda parts: F.nullif(F.array_join(_lines(parts), "<br>"), F.lit(""))
    return F.coalesce(joined(c["nested"]), joined(c["own"]), c["plain"])


def feishu_blocks(pages: DataFrame) -> DataFrame:
    """page_id, pos, type, level, text, markdown, ordered, depth, src, alt, rows, source_id, source_order of each page.

    pages: page_id, url, html. Equal source ids are one block. The order is that of the page; the place on the screen, which
    a rendered page would give as source_order, isn't known here, so a numeric block id stands for it.
    """
    return blocks_of(page_rows(pages, FIELDS, page_block_rows))


def blocks_of(tops: DataFrame) -> DataFrame:
    """The same from the rows of the pages' blocks."""
    heading = F.regexp_extract(F.array_join("classes", " "), r"(?:^| )docx-heading([1-6])-block(?: |$)", 1)
    kind = (
        F.when(heading != "", "heading").when(_has(F.col("classes"), IMAGE), "image").when(_has(F.col("classes"), TABLE), "table").when(_has(F.col("classes"), CODE), "code")
        .when(_has(F.col("classes"), QUOTE), "quote").when(_has(F.col("classes"), ORDERED, BULLET), "listItem").when(_has(F.col("classes"), TEXT) & ~_has(F.col("classes"), "isEmpty"), "paragraph")
    )
    typed = tops.withColumn("kind", kind).withColumn("level", F.nullif(heading, F.lit("")).cast("int")).where("kind is not null")

    pre, own = F.col("pre"), (F.col("record"), F.col("block_id"))
    # quotes: their children, or themselves without any that show
    told = lambda c: F.array(_item(c["pre"], "quote", c["record"], c["block_id"], lines=_lines(c["lines"])))
    said = F.flatten(F.transform("children", lambda c: F.when(c["picture"], _pictures(c["pre"], c["pictures"], c["record"], c["block_id"])).otherwise(F.filter(told(c), lambda i: F.size(i["lines"]) > 0))))
    plain = F.array(_item(pre, F.col("kind"), *own, lines=_lines(F.col("lines"))))
    quote = F.flatten(F.transform(F.array(said), lambda items: F.when(F.size(items) > 0, items).otherwise(plain)))
    code = F.array(_item(pre, "code", *own, code=normalize_code(F.array_join(F.transform("code", lambda p: F.trim(F.regexp_replace(p, f"{ANY_SPACE}+", " "))), "\n"))))
    table = F.array(_item(pre, "table", *own, rows=F.transform("cells", lambda row: F.transform(row, _cell))))
    items = (
        F.when(F.col("kind") == "image", _pictures(pre, F.col("pictures"), *own)).when(F.col("kind") == "table", F.when(F.col("cells").isNotNull(), table))
        .when(F.col("kind") == "code", F.when(F.col("code").isNotNull(), code)).when(F.col("kind") == "quote", quote).otherwise(plain)
    )
    shown = typed.select("page_id", F.col("pre").alias("top"), "level", "depth", _has(F.col("classes"), ORDERED).alias("numbered"), F.inline(items))
    full = shown.withColumn("markdown", F.array_join("lines", "<br>")).withColumn("text", F.when(F.col("lines").isNotNull(), inline_markdown_to_text(F.array_join("lines", " "))).otherwise(F.col("code")))
    full = full.where("type in ('image', 'table') or (type = 'code' and text <> '') or (markdown <> '' and (type <> 'heading' or text <> ''))")
    name = F.concat(F.when(F.col("type") == "image", "feishu-image:").otherwise("feishu-block:"), "record", F.when(F.col("several"), F.concat(F.lit(":"), F.col("part").cast("string"))).otherwise(F.lit("")))
    listed = F.col("type") == "listItem"
    named = full.select(
        "page_id", "top", "block", "part", "type", "level", "text", F.when(F.col("type") != "heading", F.col("markdown")).alias("markdown"), F.when(listed, F.col("numbered")).alias("ordered"), F.when(listed, F.col("depth")).alias("depth"),
        "src", "alt", "rows", name.alias("source_id"), F.col("block_id").try_cast("double").alias("source_order"),
    )

    # of equal ids the later one counts if it tells no less, at the place of the first; a page's rows move once
    same = Window.partitionBy("page_id", "type", "source_id")
    length = F.length(F.coalesce(F.nullif("markdown", F.lit("")), F.nullif("text", F.lit("")), F.col("src"), F.lit("")))
    best = named.repartition("page_id").withColumn("at", F.min(F.struct("top", "block", "part")).over(same)).withColumn("best", F.row_number().over(same.orderBy(F.desc(F.when(F.col("type") == "image", 0).otherwise(length)), F.desc("top"), F.desc("block"), F.desc("part")))).where("best = 1")
    pos = F.row_number().over(Window.partitionBy("page_id").orderBy("at"))
    return best.select("page_id", pos.alias("pos"), "type", "level", "text", "markdown", "ordered", "depth", "src", "alt", "rows", "source_id", "source_order")
