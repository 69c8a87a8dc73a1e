"""Queries without SQL that take whole texts, against brute force."""

from __future__ import annotations

import re

import pytest
from data_dir import SF
from pyspark.sql import functions as F

import __spark_entry__
from leafmill.functions import text as X

QUERIES = __spark_entry__.queries()


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def normal(text):
    return re.sub(r"\s+", " ", text).strip()


def joined(a, b):
    size = next((n for n in range(min(len(a), len(b)), 11, -1) if a.endswith(b[:n])), None)
    return None if size is None else a + b[size:]


def test_overlap_of_whole_halves(spark, texts):
    got = {r.doc_id: r.merged for r in QUERIES["line_overlap_merge_whole"](spark, SF).collect()}
    assert got == {i: joined(normal(t[: len(t) // 2 + i % 31]), normal(t[len(t) // 2 :])) for i, t in texts.items()}
    assert max(len(m) for m in got.values() if m) > 10_000


def test_overlap_at_any_place(spark):
    pairs = [("x" + "ab" * 40, "ab" * 30 + "c"), ("a" * 50, "a" * 30), (r"q \Eabcdefghijk+ \Eabcdefghijk+", r"\Eabcdefghijk+ z"), ("abcdefghijkl", "abcdefghijkl"), ("abcdefghijk", "abcdefghijk"), ("a" * 40 + "b", "a" * 40 + "c"), ("\U0001f600" * 20, "\U0001f600" * 15 + "x"), ("", "a"), ("a", "")]
    got = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").select("i", X.overlap_merge(F.col("a"), F.col("b")).alias("m")).collect()
    assert {r.i: r.m for r in got} == {i: joined(*p) for i, p in enumerate(pairs)}


def rendered(i, text):
    words = [w + "|" for w in re.split(r"[ \n]+", text) if w]
    k = i % 4 + 1
    rows = [[w.replace("|", "\\|") for w in words[at : at + k]] + [""] * (5 - len(words[at : at + k])) for at in range(0, len(words), k)]
    if rows:
        rows[0][4] = f"![a\\[b\\]](i%20%28{i}%29.png)"
    lines = ["| " + " | ".join(r) + " |" for r in rows]
    return "\n".join([*lines[:1], "| --- | --- | --- | --- | --- |", *lines[1:]]) if lines else ""


def test_tables_of_all_words(spark, texts):
    got = {r.doc_id: r.markdown for r in QUERIES["table_render_whole"](spark, SF).collect()}
    assert got == {i: rendered(i, t) for i, t in texts.items()}
    assert max(m.count("\n") for m in got.values()) > 1000
