"""Runs of neighbouring blocks, by windows over a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import list_depth, trimmed_text

NUMBER_ONLY = r"^[0-9]+[.)\x{3001}]?$"


def join_split_numbers(blocks: DataFrame, page: str = "page_id", pos: str = "pos") -> DataFrame:
    """A list item that is only a number goes; the item after it, if it is another one, becomes numbered, at the lesser depth."""
    run = Window.partitionBy(page).orderBy(pos)
    number = (F.col("type") == "listItem") & F.trim("text").rlike(NUMBER_ONLY)
    plain = (F.col("type") == "listItem") & ~F.trim("text").rlike(NUMBER_ONLY)
    marked = blocks.select("*", number.alias("_number"), F.lag(number, 1, False).over(run).alias("_after"), F.lead(plain, 1, False).over(run).alias("_before"), F.lag("depth").over(run).alias("_depth"))
    follows = F.col("_after") & plain
    return (
        marked.withColumn("ordered", F.when(follows, F.lit(True)).otherwise(F.col("ordered")))
        .withColumn("depth", F.when(follows, F.least(list_depth(F.col("depth")), list_depth(F.col("_depth")))).otherwise(F.col("depth")))
        .where(~(F.col("_number") & F.col("_before")))
        .drop("_number", "_after", "_before", "_depth")
    )


def runs(blocks: DataFrame, belongs: Column, page: str = "page_id", pos: str = "pos") -> DataFrame:
    """blocks with run: equal for neighbours that belong, a number of its own for each other block."""
    order = Window.partitionBy(page).orderBy(pos)
    starts = ~belongs | ~F.coalesce(F.lag(belongs).over(order), F.lit(False))
    return blocks.withColumn("_start", starts.cast("int")).withColumn("run", F.sum("_start").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_start")


def list_line(ordered: Column, depth: Column, text: Column) -> Column:
    return F.concat(F.repeat(F.lit("    "), list_depth(depth)), F.when(ordered, F.lit("1. ")).otherwise(F.lit("- ")), trimmed_text(text))


def compact_lists(blocks: DataFrame, page: str = "page_id", pos: str = "pos") -> DataFrame:
    """page, pos, type, text, n_items: neighbouring list items as one paragraph, a single one as it is."""
    item = F.col("type") == "listItem"
    line = list_line(F.coalesce("ordered", F.lit(False)), F.col("depth"), F.col("text"))
    grouped = runs(blocks, item, page, pos).groupBy(page, "run").agg(
        F.min(pos).alias(pos),
        F.count(F.lit(1)).cast("int").alias("n_items"),
        F.min("type").alias("kind"),
        F.min(F.struct(pos, "text"))["text"].alias("first"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"),
    )
    many = (F.col("kind") == "listItem") & (F.col("n_items") > 1)
    return grouped.select(page, pos, F.when(many, "paragraph").otherwise(F.col("kind")).alias("type"), F.when(many, F.col("lines")).otherwise(F.col("first")).alias("text"), "n_items")


def wrap_quotes(blocks: DataFrame, page: str = "page_id", pos: str = "pos") -> DataFrame:
    """page, pos, type, text: runs between pictures, code and tables as one quote each."""
    apart = F.col("type").isin("image", "code", "table")
    grouped = runs(blocks, ~apart, page, pos).groupBy(page, "run").agg(
        F.min(pos).alias(pos),
        F.min("type").alias("kind"),
        F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col("text").alias("t")))), lambda x: x["t"]), lambda t: F.coalesce(t, F.lit("")) != ""), "\n").alias("text"),
    )
    return grouped.select(page, pos, F.when(F.col("kind").isin("image", "code", "table"), F.col("kind")).otherwise(F.lit("quote")).alias("type"), "text")
