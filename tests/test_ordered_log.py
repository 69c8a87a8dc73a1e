from __future__ import annotations

from data_dir import SF
from pyspark.sql import functions as F

from leafmill.operators import blocks as B
from leafmill.operators import merge, ordered_log
from leafmill.plans import queries


def test_numbers_of_the_whole_table(spark):
    rows = spark.range(500).select((F.col("id") % 7).alias("a"), F.when(F.col("id") % 5 > 0, F.col("id") * 37 % 500).alias("b"))
    got = [(r.line_no, r.a, r.b) for r in ordered_log.numbered(rows, "a", "b").orderBy("line_no").collect()]
    assert [g[0] for g in got] == list(range(1, 501))
    assert [g[1:] for g in got] == sorted((g[1:] for g in got), key=lambda r: (r[0], r[1] is not None, r[1] or 0))
    assert ordered_log.numbered(rows.where("a > 9"), "a").count() == 0


def test_log_text_query(spark):
    """The files one after another are the lines of the whole log in order."""
    parts = queries.log_text(spark, SF).orderBy("part").collect()
    lines = [r.line for r in queries.ordered_log(spark, SF).orderBy("line_no").collect()]
    assert "".join(r.text for r in parts) == "".join(line + "\n" for line in lines)


def test_selected_areas(spark):
    long = "word " * 40
    html = f"<nav><p>menu</p></nav><article><h1>T</h1><p>{long}</p><p>b</p><p>c</p></article>"
    few = f"<article><p>{long}</p><p>b</p></article>"
    rows = [(1, html, "nav", 0), (2, html, "article", 0), (3, html, "p", 3), (4, html, "table", 0), (5, few, "p", 0), (6, None, "p", 0), (7, html, None, None), (8, html, "p", -1), (9, "<p>x</p>", "p", 0)]
    pages = spark.createDataFrame(rows, "page_id long, html string, tag string, nth int").withColumn("url", F.lit("https://e.com/"))
    got = {r.page_id: (r.n_selected, r.promoted, r.blocks and [b.text.strip() for b in r.blocks]) for r in B.selected_areas(pages, F.col("tag"), F.col("nth")).collect()}
    whole = ["T", long.strip(), "b", "c"]
    # a small selection gives way, but not to an area with two blocks more or less
    assert got == {1: (1, True, whole), 2: (4, False, whole), 3: (1, True, whole), 4: (None, False, whole), 5: (1, False, [long.strip()]), 6: (None, None, None), 7: (None, False, whole), 8: (None, False, whole), 9: (1, False, ["x"])}


def test_only_first_blocks_are_folded(spark):
    """A page with a third of all rows, which repeats few blocks, comes to the fold with each of them once; sources stay."""
    same = [(1, n, 0, "paragraph", f"text {n % 4}", None) for n in range(300)] + [(2, n, 0, "paragraph", f"own {n}", None) for n in range(30)] + [(3, n, 0, "paragraph", "s" * n, "src") for n in range(3)]
    rounds = spark.createDataFrame(same, "page_id long, round int, pos int, type string, text string, source_id string")
    kept = merge._firsts(rounds, "page_id", "round", ["type", "text", "source_id"])
    assert {r[0]: r[1] for r in kept.groupBy("page_id").count().collect()} == {1: 4, 2: 30, 3: 3}
    merged = merge.merge_rounds(rounds, "accumulate", "page_id", "round", "type string, text string, source_id string").where("page_id <> 2").orderBy("page_id", "pos").collect()
    assert [(r.page_id, r.text) for r in merged] == [(1, f"text {n}") for n in range(4)] + [(3, "ss")]
    latest = merge.merge_rounds(rounds, "latest", "page_id", "round", "type string, text string, source_id string").where("page_id = 1").collect()
    assert [r.text for r in latest] == ["text 3"]
