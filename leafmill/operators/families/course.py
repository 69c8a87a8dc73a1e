"""Course pages: items that may hold items, with text zones, lists, code, grids of cells, pictures and videos.

Every item comes with what is in it and around it; what it becomes, and which of equal blocks stays, is decided here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...functions.text import code_language, heading_level, inline_markdown_to_text, normalize_indented_code, normalize_inline_markdown, normalize_text, once
from ...sources.html_marks import page_rows
from ...sources.item_rows import COURSE_FIELDS, page_course_rows
from ..blocks import absolute, image_source

LINK_ICON = r"(?i)/images/docx/link\.png$"
BLOCK = (
    ("part", "int"), ("type", "string"), ("level", "int"), ("text", "string"), ("markdown", "string"), ("ordered", "boolean"), ("depth", "int"), ("language", "string"), ("src", "string"), ("alt", "string"), ("rows", "array<array<string>>"),
    ("source_id", "string"),
)
OF_PART = f"struct<{','.join(f'{n}:{t}' for n, t in BLOCK)}>"


def item_text(shown: Column) -> Column:
    """The lines that an item shows, one for each end of its tree."""
    zones = lambda e: F.array_join(F.filter(F.transform(e["zones"], normalize_inline_markdown), lambda x: x != ""), "<br>")
    each = F.transform(shown, lambda e: F.when(e["zones"].isNotNull(), zones(e)).otherwise(normalize_inline_markdown(F.coalesce(e["bullet"], e["whole"]))))
    return F.array_join(F.filter(each, lambda x: x != ""), "<br>")


def grid_rows() -> Column:
    """The rows of an item's grid, the last one filled up: a cell has the lines of its items or its own."""
    width, cells = F.col("width"), F.transform("cells", lambda c: F.coalesce(item_text(c["nested"]), normalize_inline_markdown(c["own"])))

    def rows(given: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.ceil(F.size(given) / width).cast("int") - 1), lambda r: F.slice(given, r * width + 1, width))
        return F.transform(cut, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))

    return F.when(F.size("cells") > 0, once(cells, rows))


def numbered() -> Column:
    return F.exists(F.concat("classes", "first_classes"), lambda c: c.rlike("(?i)ordered|number"))


def body_picture(attrs: Column) -> Column:
    """Whether a picture is one of the text's."""
    raw = F.coalesce(F.nullif(attrs["src"], F.lit("")), attrs["data-src"], F.lit(""))
    return (raw != "") & ~raw.rlike("(?i)^data:image/") & ~F.regexp_replace(raw, "[?#].*$", "").rlike(LINK_ICON)


def course_blocks(pages: DataFrame) -> DataFrame:
    """page_id, pos, type, level, text, markdown, ordered, depth, language, src, alt, rows, source_id of each course page.

    pages: page_id, url, html. Grid cells hold the lines of their items or their own; pictures of a grid come after its rows.
    """
    return blocks_of(page_rows(pages, COURSE_FIELDS, page_course_rows))


def blocks_of(rows: DataFrame) -> DataFrame:
    """The same from the rows of the pages' items and headings."""
    nested = F.array_join(F.transform(F.slice("way", 2, F.size("way")), lambda n: (n - 1).cast("string")), ".")
    name = F.concat(F.lit("scys:"), F.get("way", F.lit(0)).cast("string"), F.when(F.size("way") > 1, F.concat(F.lit(":nested:"), nested)).otherwise(F.lit("")))
    full = rows.select(
        "page_id", "url", "pre", "is_list", "quoted", "depth", "video", "title", "pictures", F.coalesce("level", heading_level(F.col("classes"))).alias("level"), F.when(F.col("way").isNotNull(), name).alias("name"), numbered().alias("numbered"),
        item_text(F.col("shown")).alias("markdown"), F.coalesce(F.when(F.col("code").isNotNull(), normalize_indented_code(F.col("code"))), F.lit("")).alias("code"), F.when(F.col("language").isNotNull(), code_language(F.col("language"))).alias("language"), grid_rows().alias("rows"),
    )
    kind = (
        F.when(F.col("title").isNotNull(), "heading").when(F.col("video").isNotNull(), "video").when(F.col("level").isNotNull(), "heading").when(~F.col("is_list") & (F.col("code") != ""), "code")
        .when(~F.col("is_list") & (F.col("code") == "") & F.col("rows").isNotNull(), "table").when(F.col("is_list"), "listItem").when(F.col("quoted"), "quote").otherwise("paragraph")
    )
    typed = full.withColumn("type", kind)
    kind, of = F.col("type"), lambda *names: F.col("type").isin(*names)
    none = lambda t: F.lit(None).cast(t)
    text = F.when(kind == "heading", normalize_text(F.coalesce("title", "markdown"))).when(kind == "code", F.col("code")).when(kind == "video", F.col("video.text")).when(kind != "table", inline_markdown_to_text(F.col("markdown")))
    block = lambda **given: F.struct(*[given.get(n, none(t)).cast(t).alias(n) for n, t in BLOCK])
    own = block(
        part=F.lit(-1), type=kind, level=F.when(kind == "heading", F.col("level")), text=text, markdown=F.when(kind == "quote", F.replace("markdown", F.lit("<br>"), F.lit("\n"))).when(of("listItem", "paragraph"), F.col("markdown")),
        ordered=F.when(kind == "listItem", F.col("numbered")), depth=F.when((kind == "listItem") | ((kind == "quote") & (F.col("depth") > 0)), F.col("depth")), language=F.when(kind == "code", F.coalesce("language", F.lit(""))),
        src=F.when(kind == "video", F.col("video.src")), rows=F.when(kind == "table", F.col("rows")), source_id=F.when(kind == "table", F.concat("name", F.lit(":table"))).when(kind == "video", F.concat("name", F.lit(":video:0"))),
    )
    shown = lambda a, k: block(part=k, type=F.lit("image"), src=absolute(image_source(a), F.coalesce("url", F.lit(""))), alt=normalize_text(a["alt"]), source_id=F.concat("name", F.lit(":image:"), k.cast("string")))
    pictures = F.when((kind != "table") & (F.size("pictures") > 0), F.transform(F.filter("pictures", body_picture), shown)).otherwise(F.array().cast(f"array<{OF_PART}>"))
    every = typed.select("page_id", "pre", F.inline(F.concat(F.array(own), pictures))).where("type in ('table', 'video', 'code', 'image') or coalesce(text, '') <> ''")

    # of equal blocks the first stays; a page's rows move once
    key = F.struct("type", F.coalesce("source_id", F.concat_ws("\x1f", F.coalesce(F.col("level").cast("string"), F.lit("")), F.coalesce("text", F.lit("")), F.coalesce("markdown", F.lit("")), F.coalesce(F.col("ordered").cast("string"), F.lit("false")), F.coalesce(F.col("depth").cast("string"), F.lit("")))))
    firsts = every.repartition("page_id").withColumn("nr", F.row_number().over(Window.partitionBy("page_id", key).orderBy("pre", "part"))).where("nr = 1")
    return firsts.select("page_id", F.row_number().over(Window.partitionBy("page_id").orderBy("pre", "part")).alias("pos"), "type", "level", "text", "markdown", "ordered", "depth", "language", "src", "alt", "rows", "source_id")
