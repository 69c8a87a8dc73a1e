from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from leafmill.functions import lines as L

DOT, TEE, END, BAR = chr(0x2022), chr(0x251C), chr(0x2514), chr(0x2502)
DASH = chr(0x2500) * 2


def run(spark, made, text):
    return spark.createDataFrame([(text,)], "v string").select(made(F.col("v"))).first()[0]


@pytest.mark.parametrize("text, want", [
    (f"{DOT} a\n\n* b\n+ c\n\n1) d\n\n2. e", "- a\n- b\n- c\n1. d\n2. e"),
    ("  - a\n\n- b", "- a\n\n- b"),
    ("a  \n\n\n\nb****c", "a\n\nbc"),
    ("```py\n* x\n\n\n* y\n``\n````\n* z", "```py\n* x\n\n\n* y\n``\n````\n- z"),
    ("~~~\n* x\n```\n~~~\n* y", "~~~\n* x\n```\n~~~\n- y"),
    ("- a\r\n\r\n- b\r", "- a\n- b"),
    ("", ""),
    (None, ""),
])
def test_lists(spark, text, want):
    assert run(spark, L.plain_lists, text) == want


def test_trees(spark):
    tree = f"src/\n{TEE}{DASH} a\n\n{BAR}  {END}{DASH} b\n\nend"
    assert run(spark, L.fenced_trees, tree) == f"```text\nsrc/\n{TEE}{DASH} a\n{BAR}  {END}{DASH} b\n```\n\nend"
    for same in (f"src/\n{TEE}{DASH} a\nx", f"https://x/\n{TEE}{DASH} a\n{END}{DASH} b", f"```\nsrc/\n{TEE}{DASH} a\n{END}{DASH} b\n```", "src/"):
        assert run(spark, L.fenced_trees, same) == same
    assert run(spark, L.fenced_trees, f"a/\n{TEE}{DASH} b/\n{TEE}{DASH} c\n{TEE}{DASH} d").count("```") == 2
