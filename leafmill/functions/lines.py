"""Line rules of Markdown texts, as folds over the array of lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, once, strip_all, text_of

# What opens a fence, a list item and a branch of a directory tree, and what a directory's name isn't.
FENCE = f"^[{SPACE}]*(`{{3,}}|~{{3,}})"
DOT = rf"^([{SPACE}]*)[\x{{2022}}\x{{25CF}}\x{{25AA}}\x{{25AB}}\x{{25E6}}\x{{B7}}][{SPACE}]*([^{SPACE}].*)$"
BULLET = rf"^([{SPACE}]*)[-+*][{SPACE}]+([^{SPACE}].*)$"
NUMBER = rf"^([{SPACE}]*)(\d+)[.)][{SPACE}]+([^{SPACE}].*)$"
MARKER = rf"^([{SPACE}]*)(?:-|\d+\.)[{SPACE}]+.*$"
BRANCH = rf"^[{SPACE}]*(?:\x{{2502}}[{SPACE}]*)*[\x{{251C}}\x{{2514}}]\x{{2500}}\x{{2500}}[{SPACE}]*[^{SPACE}]"
NO_DIRECTORY = "^(?:https?://|[#>*|`-])"
LONGEST_DIRECTORY, LEAST_BRANCHES = 180, 2
# What plain_lists() does more with than with a paragraph: marks of lists and fences at the start of a line, blank
# lines after blank lines, emphasis without a text, branches.
NOT_PLAIN = rf"(?m)^(?:[{SPACE}]*(?:[-+*\x{{2022}}\x{{25CF}}\x{{25AA}}\x{{25AB}}\x{{25E6}}\x{{B7}}]|\d+[.)]|`{{3}}|~{{3}})|[{SPACE}&&[^\n]]*\n[{SPACE}&&[^\n]]*\n)"
NOT_PLAIN_PARTS = ("****", chr(0x2500) * 2)


def with_fences(lines: Column) -> Column:
    """(line, code) of each line; code is true from the line that opens a fence to the one that closes it."""

    def step(acc: Column, line: Column) -> Column:
        mark = F.regexp_extract(line, FENCE, 1)
        inside = acc["mark"] != ""
        closes = inside & (mark != "") & (F.left(mark, F.lit(1)) == F.left(acc["mark"], F.lit(1))) & (F.length(mark) >= F.length(acc["mark"]))
        return F.struct(
            F.when(closes, "").when(inside, acc["mark"]).otherwise(mark).alias("mark"),
            F.concat(acc["out"], F.array(F.struct(line.alias("line"), (inside | (mark != "")).alias("code")))).alias("out"),
        )

    start = F.struct(F.lit("").alias("mark"), F.array().cast("array<struct<line:string,code:boolean>>").alias("out"))
    return F.aggregate(lines, start, step, lambda acc: acc["out"])


def plain_lists(value: Column) -> Column:
    """Markdown whose lists are written one way: `-` for all bullets, `1.` for numbers, no blank line between items of one
    indent, one blank line at most elsewhere, and directory trees fenced. Code in fences stays as it is."""
    return once(F.regexp_replace(text_of(value), r"\r\n?", "\n"), lambda text: F.when(text.contains(NOT_PLAIN_PARTS[0]) | text.contains(NOT_PLAIN_PARTS[1]) | text.rlike(NOT_PLAIN), _plain_lists(text)).otherwise(_plain_text(text)))


def _plain_text(text: Column) -> Column:
    """plain_lists() of a text without lists, fences and trees: most are, and need no fold over their lines."""
    return strip_all(F.regexp_replace(F.replace(text, F.lit(chr(0xA0)), F.lit(" ")), r"[ \t]+(?=[\x{85}\x{2028}\x{2029}]?(?:\n|\z))", ""))


def _plain_lists(text: Column) -> Column:
    lines = F.split(text, "\n")

    def written(e: Column) -> Column:
        line = F.regexp_replace(F.replace(F.replace(e["line"], F.lit(chr(0xA0)), F.lit(" ")), F.lit("****"), F.lit("")), r"[ \t]+$", "")
        line = F.when(line.rlike(DOT), F.regexp_replace(line, DOT, "$1- $2")).when(line.rlike(BULLET), F.regexp_replace(line, BULLET, "$1- $2")).otherwise(F.regexp_replace(line, NUMBER, "$1$2. $3"))
        return F.struct(F.when(e["code"], e["line"]).otherwise(line).alias("line"), e["code"].alias("code"))

    blank = lambda e: ~e["code"] & (strip_all(e["line"]) == "")
    indent = lambda e: F.when(~e["code"] & e["line"].rlike(MARKER), F.regexp_extract(e["line"], MARKER, 1))

    def compact(rows: Column) -> Column:
        between = lambda i: F.coalesce(indent(F.get(rows, i - 1)) == indent(F.get(rows, i + 1)), F.lit(False))
        return F.filter(rows, lambda e, i: ~(blank(e) & between(i)))

    def squeezed(rows: Column) -> Column:
        return F.filter(rows, lambda e, i: ~(blank(e) & F.coalesce(blank(F.get(rows, i - 1)), F.lit(False))))

    rows = once(once(F.transform(with_fences(lines), written), compact), squeezed)
    return strip_all(fenced_trees(F.array_join(F.transform(rows, lambda e: e["line"]), "\n")))


def fenced_trees(value: Column) -> Column:
    """A directory's name with two branches or more below it, blank lines aside, becomes a fenced block of text."""

    def ahead(rows: Column) -> Column:
        """(line, code, branches): how many branches follow each line before another line that isn't blank."""
        follow = F.aggregate(
            F.reverse(rows),
            F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<line:string,code:boolean,branches:int>>").alias("out")),
            lambda acc, e: F.struct(
                F.when(e["line"].rlike(BRANCH), acc["n"] + 1).when(strip_all(e["line"]) == "", acc["n"]).otherwise(F.lit(0)).alias("n"),
                F.concat(F.array(F.struct(e["line"].alias("line"), e["code"].alias("code"), acc["n"].alias("branches"))), acc["out"]).alias("out"),
            ),
            lambda acc: acc["out"],
        )
        return follow

    def step(acc: Column, e: Column) -> Column:
        name = strip_all(e["line"])
        starts = (acc["left"] == 0) & ~e["code"] & name.endswith("/") & (F.length(name) <= LONGEST_DIRECTORY) & ~name.rlike(NO_DIRECTORY) & (e["branches"] >= LEAST_BRANCHES)
        branch = e["line"].rlike(BRANCH)
        added = (
            F.when(starts, F.array(F.lit("```text"), name))
            .when((acc["left"] > 0) & ~branch, F.array().cast("array<string>"))
            .when(acc["left"] == 1, F.array(e["line"], F.lit("```")))
            .otherwise(F.array(e["line"]))
        )
        left = F.when(starts, e["branches"]).when((acc["left"] > 0) & branch, acc["left"] - 1).otherwise(acc["left"])
        return F.struct(left.cast("int").alias("left"), F.concat(acc["out"], added).alias("out"))

    rows = once(with_fences(F.split(text_of(value), "\n")), ahead)
    start = F.struct(F.lit(0).alias("left"), F.array().cast("array<string>").alias("out"))
    return F.array_join(F.aggregate(rows, start, step, lambda acc: acc["out"]), "\n")
