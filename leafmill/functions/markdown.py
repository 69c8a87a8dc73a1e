"""Blocks and documents as Markdown, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import escape_label, escape_url, list_depth, normalize_code, normalize_text, table_cell, text_of, trimmed_text

IMAGE = "struct<src:string,alt:string,row_index:int,column_index:int,source_id:string>"
#: The fields of a block; what a kind of block lacks is null.
BLOCK = (
    "struct<type:string,text:string,markdown:string,level:int,ordered:boolean,depth:int,language:string,src:string,alt:string,href:string,"
    f"rows:array<array<string>>,images:array<{IMAGE}>,embedded_data_url:string,source_id:string,source_order:double>"
)


def _link(label: Column, target: Column, mark: str = "") -> Column:
    return F.concat(F.lit(f"{mark}["), escape_label(label), F.lit("]("), escape_url(target), F.lit(")"))


def table_markdown(rows: Column, images: Column) -> Column:
    """Rows of the first one's head; an image goes to its cell, which makes the row longer if it must. Empty rows go first."""
    cells = F.transform(F.filter(F.coalesce(rows, F.array().cast("array<array<string>>")), lambda r: F.size(r) > 0), lambda r: F.transform(r, table_cell))
    marks = F.transform(
        F.filter(F.coalesce(images, F.array().cast(f"array<{IMAGE}>")), lambda i: (text_of(i["src"]) != "") & (i["column_index"] >= 0)),
        lambda i: F.struct(i["row_index"].alias("row"), i["column_index"].alias("column"), F.replace(_link(i["alt"], i["src"], "!"), F.lit("|"), F.lit("\\|")).alias("mark")),
    )

    def placed(row: Column, own: Column) -> Column:
        width = F.greatest(F.size(row), F.coalesce(F.array_max(F.transform(own, lambda i: i["column"])) + 1, F.lit(0)))
        long = F.concat(row, F.array_repeat(F.lit(""), width - F.size(row)))
        return F.transform(long, lambda cell, at: F.array_join(F.concat(F.filter(F.array(cell), lambda c: c != ""), F.transform(F.filter(own, lambda i: i["column"] == at), lambda i: i["mark"])), "<br>"))

    def filled(t: Column) -> Column:
        return F.transform(t["cells"], lambda row, number: placed(row, F.filter(t["marks"], lambda i: i["row"] == number)))

    def measured(table: Column) -> Column:
        return F.struct(table.alias("rows"), F.array_max(F.transform(table, F.size)).alias("width"))

    def line(cells: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    def lines(t: Column) -> Column:
        rule = line(F.array_repeat(F.lit("---"), t["width"]))

        def row_lines(row: Column, number: Column) -> Column:
            own = line(F.concat(row, F.array_repeat(F.lit(""), t["width"] - F.size(row))))
            return F.when(number == 0, F.concat(own, F.lit("\n"), rule)).otherwise(own)

        return F.array_join(F.transform(t["rows"], row_lines), "\n")

    # each step's result is the element of an array, so that it is worked out once
    step = F.transform(F.transform(F.array(F.struct(cells.alias("cells"), marks.alias("marks"))), filled), measured)
    step = F.transform(step, lambda t: F.when(F.size(t["rows"]) == 0, F.lit("")).otherwise(lines(t)))
    return F.get(step, F.lit(0))


def block_markdown(b: Column) -> Column:
    """The Markdown of one block; empty for a block that has nothing to show, but a fence for empty code."""
    kind = b["type"]
    shown = trimmed_text(F.coalesce(F.nullif(b["markdown"], F.lit("")), b["text"]))
    indent = F.repeat(F.lit("    "), list_depth(b["depth"]))
    level = F.least(F.greatest(F.coalesce(F.nullif(b["level"], F.lit(0)), F.lit(2)), F.lit(1)), F.lit(6))
    code = normalize_code(b["text"])
    ticks = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(code, F.lit("(`+)"), 1), F.length)), F.lit(0))
    fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), ticks + 1))
    language = F.regexp_replace(F.lower(text_of(b["language"])), "[^a-z0-9_-]+", "")
    or_none = lambda text, made: F.when(text != "", made).otherwise(F.lit(""))
    return (
        F.when(kind == "heading", or_none(trimmed_text(b["text"]), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), trimmed_text(b["text"]))))
        .when(kind == "image", or_none(text_of(b["src"]), _link(b["alt"], b["src"], "!")))
        .when(kind == "video", or_none(text_of(b["src"]), _link(F.coalesce(F.nullif(b["text"], F.lit("")), F.lit("Video")), b["src"])))
        .when(kind == "link", or_none(text_of(b["href"]), _link(F.coalesce(F.nullif(b["text"], F.lit("")), b["href"]), b["href"])))
        .when(kind == "listItem", or_none(shown, F.concat(indent, F.when(b["ordered"], F.lit("1. ")).otherwise(F.lit("- ")), shown)))
        .when(kind == "quote", or_none(shown, F.array_join(F.transform(F.split(shown, "\n"), lambda line: F.concat(indent, F.lit("> "), line)), "\n")))
        .when(kind == "code", F.concat(fence, language, F.lit("\n"), code, F.lit("\n"), fence))
        .when(kind == "table", table_markdown(b["rows"], b["images"]))
        .when(kind.isNull() | (kind == ""), F.lit(""))
        .otherwise(shown)
    )


def document_markdown(title: Column, url: Column, captured: Column, blocks: Column) -> Column:
    """Head with the title, source and capture time that there are, then the blocks, one line end at the end."""
    head = F.coalesce(F.nullif(normalize_text(title), F.lit("")), F.lit("Untitled"))
    source, when = normalize_text(url), normalize_text(captured)
    body = F.array_join(F.filter(F.transform(blocks, block_markdown), lambda m: m != ""), "\n\n")
    lines = F.filter(
        F.array(
            F.concat(F.lit("# "), head),
            F.lit(""),
            F.when(source != "", F.concat(F.lit("Source: "), source)),
            F.when(when != "", F.concat(F.lit("Captured: "), when)),
            F.when((source != "") | (when != ""), F.lit("")),
        ),
        lambda line: line.isNotNull(),
    )
    # the body is worked out once; its blocks have no white space at their ends
    whole = lambda b: F.when(b == "", trimmed_text(F.array_join(lines, "\n"))).otherwise(F.concat(F.array_join(lines, "\n"), F.lit("\n"), b))
    return F.concat(F.get(F.transform(F.array(body), whole), F.lit(0)), F.lit("\n"))
