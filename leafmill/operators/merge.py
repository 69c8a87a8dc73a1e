"""Merging what was read of a page in several rounds.

A page's rounds depend on one another, so each page is folded in order by a small function; Spark deals the pages out. A
block is a dictionary with the fields of leafmill.functions.markdown.BLOCK.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import list_depth, normalize_text, text_of

OVERLAP = 12
_INVISIBLE = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufeff]")
_SPACES = re.compile("[\\t\\n\\x0b\\f\\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def squeeze(text: str | None) -> str:
    if not text:
        return ""
    if text.isascii() and text.replace("\n", " ").isprintable():  # nothing to leave out, and no other white space
        return " ".join(text.split())
    return _SPACES.sub(" ", _INVISIBLE.sub("", text)).strip(" ")


def key(block: dict) -> str:
    """Equal for blocks that count as the same."""
    kind, get = block.get("type"), lambda name: block.get(name) or ""
    if not kind:
        return "unknown"
    if get("source_id"):
        own = ["source", get("source_id")]
    elif kind == "heading":
        own = [block.get("level") or 0, squeeze(get("text"))]
    elif kind == "link":
        own = [squeeze(get("text")), get("href")]
    elif kind == "image":
        own = [get("src"), squeeze(get("alt"))]
    elif kind == "video":
        own = [get("src"), squeeze(get("text"))]
    elif kind == "table":
        own = [[list(r) for r in block.get("rows") or []]]
    else:
        own = [squeeze(get("text")), get("markdown"), bool(get("ordered")), *([max(0, int(block.get("depth") or 0))] if kind == "listItem" else [])]
    return json.dumps([kind, *own], ensure_ascii=False)


def richness(block: dict) -> int:
    """How much a block tells: cells and pictures of a table, else the length of its Markdown, text or address."""
    if block.get("type") == "table":
        cells = [c or "" for row in block.get("rows") or [] for c in row]
        return 1000 * (sum(bool(squeeze(c)) for c in cells) + len(block.get("images") or [])) + sum(map(len, cells))
    return len(block.get("markdown") or block.get("text") or block.get("src") or "")


def fuse(old: dict, new: dict) -> dict:
    """Of two readings of a block the later picture, else the richer one, ties to the later; what it lacks is inherited."""
    if new.get("type") != "image" and richness(new) < richness(old):
        return old
    return old | {k: v for k, v in new.items() if v is not None}


def distinct(blocks: Iterable[dict]) -> list[dict]:
    """The first of each key, fused with later readings of the same source."""
    found: dict[str, dict] = {}
    for block in blocks:
        k = key(block)
        if k not in found:
            found[k] = block
        elif block.get("source_id"):
            found[k] = fuse(found[k], block)
    return list(found.values())


def overlap(left: str, right: str) -> str | None:
    """Both joined at the longest end of one that starts the other; None under OVERLAP."""
    a, b = squeeze(left), squeeze(right)
    size = next((n for n in range(min(len(a), len(b)), OVERLAP - 1, -1) if a.endswith(b[:n])), 0)
    return a + b[size:] if size else None


class Fragments:
    """What merge_fragments() makes of the blocks so far; places has the place of each key, None for what is a part of another
    block or was joined."""

    def __init__(self, out: list[dict] | None = None, places: dict[str, int | None] | None = None, faithful: bool = True) -> None:
        self.out, self.places, self.faithful = out if out is not None else [], places if places is not None else {}, faithful

    def add(self, block: dict) -> None:
        out, k = self.out, key(block)
        if k in self.places:
            if block.get("source_id") and self.places[k] is not None:
                out[self.places[k]] = fuse(out[self.places[k]], block)
            return
        plain = lambda b: b.get("type") == "paragraph" and not b.get("source_id")
        joined = overlap(out[-1].get("text"), block.get("text")) if out and plain(out[-1]) and plain(block) else None
        self.places[k] = None if joined is not None else len(out)
        if joined is None:
            out.append(dict(block))
        else:
            out[-1] = out[-1] | {"text": joined} | ({} if self.faithful else {"markdown": None})
            self.places[key(out[-1])] = len(out) - 1

    def merged(self) -> list[dict]:
        if all(b.get("source_order") is not None for b in self.out):
            return sorted(self.out, key=lambda b: b["source_order"])
        return self.out


def merge_fragments(fragments: Iterable[list[dict]], faithful: bool = True) -> list[dict]:
    """All rounds one after another: distinct, overlapping paragraphs joined, in source order if every block has one.

    A joined paragraph keeps its Markdown, which then lacks the tail; without faithful it is dropped, so that the text shows.
    """
    found = Fragments(faithful=faithful)
    for block in (b for blocks in fragments for b in blocks):
        found.add(block)
    return found.merged()


def merge_ordered(known: list[dict], snapshot: list[dict]) -> list[dict]:
    """Known blocks with the snapshot's new ones where their neighbours in the snapshot stand.

    A new block goes before the next neighbour that was known, unless the one before it stands behind that; then, as
    without a known next one, after the one before it; without either at the end.
    """
    out = {key(b): b for b in distinct(known)}
    fresh = {key(b): b for b in distinct(snapshot)}
    if not out:
        return list(fresh.values())
    nexts, following = {}, None
    for k in reversed(fresh):
        nexts[k] = following
        following = k if k in out else following
    # a doubly linked list; known blocks have even ranks, new ones the odd rank beside the known one that they are put next to
    order = [None, *out, None]
    before_of, after_of = dict(zip(order[1:], order)), dict(zip(order, order[1:]))
    rank = {k: 2 * i for i, k in enumerate(out)}
    before = None
    for k, block in fresh.items():
        if k in out:
            if block.get("source_id"):
                out[k] = fuse(out[k], block)
        else:
            anchor = nexts[k]
            if anchor is not None and (before is None or rank[before] < rank[anchor]):
                left, right, rank[k] = before_of[anchor], anchor, rank[anchor] - 1
            else:
                left = before if before is not None else before_of[None]
                right, rank[k] = after_of[left], rank[left] | 1
            before_of[k], after_of[k] = left, right
            after_of[left] = before_of[right] = k
            out[k] = block
        before = k
    merged, k = [], after_of[None]
    while k is not None:
        merged.append(out[k])
        k = after_of[k]
    return merged


def _firsts(rounds: DataFrame, page: str, number: str, fields: list[str]) -> DataFrame:
    """rounds without the blocks whose key their page had before, which change nothing; each task leaves out its own first.
    Blocks with a source stay, since a later reading of one may be the richer one."""
    has = lambda name: F.col(name) if name in fields else F.lit(None)
    of = lambda *kinds: has("type").isin(*kinds)
    plain = ~of("heading", "link", "image", "video", "table")
    key = F.struct(
        has("type").alias("type"), F.when(~of("image", "table"), normalize_text(has("text"))).alias("text"), F.when(of("heading"), F.coalesce(has("level"), F.lit(0))).alias("level"), F.when(of("link"), text_of(has("href"))).alias("href"),
        F.when(of("image", "video"), text_of(has("src"))).alias("src"), F.when(of("image"), normalize_text(has("alt"))).alias("alt"), F.when(plain, text_of(has("markdown"))).alias("markdown"),
        F.when(plain, F.coalesce(has("ordered"), F.lit(False))).alias("ordered"), F.when(of("listItem"), list_depth(has("depth"))).alias("depth"), F.when(of("table"), has("rows").cast("string")).alias("rows"),
    )
    own = F.when((text_of(has("source_id")) != "") | text_of(has("type")).isin("", "table"), F.struct(number, "pos"))
    whole = F.struct(number, "pos", *fields)
    return rounds.groupBy(page, key.alias("key"), own.alias("own")).agg(F.min_by(whole, F.struct(number, "pos")).alias("b")).select(page, "b.*")


def merge_rounds(rounds: DataFrame, mode: str, page: str, number: str, schema: str) -> DataFrame:
    """page, pos and the fields in schema ("type string, text string ...") of each page's merged blocks.

    rounds has page, number, pos and these fields, a row for each block. mode: accumulate, latest or ordered. Latest folds the
    last round of each page, accumulate the first of equal blocks, which are found with partial aggregation; ordered all
    rounds. What is folded of one page is in one task's memory.
    """
    fields = [f.split()[0] for f in schema.split(", ")]
    rounds = rounds.select(page, number, "pos", *fields)
    if mode == "latest":
        newest = rounds.groupBy(page).agg(F.max(number).alias(number))
        rounds = rounds.join(newest, [page, number], "left_semi")
    elif mode == "accumulate":
        rounds = _firsts(rounds, page, number, fields)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([number, "pos"], kind="stable").astype(object).where(lambda d: d.notna(), None)
        parts = [[dict(zip(fields, row)) for row in g[fields].itertuples(index=False)] for _, g in pdf.groupby(number, sort=True)]
        if mode == "ordered":
            merged: list[dict] = []
            for part in parts:
                merged = merge_ordered(merged, part)
        else:
            merged = merge_fragments(parts[-1:] if mode == "latest" else parts)
        return pd.DataFrame([[pdf[page].iloc[0], i, *(b.get(f) for f in fields)] for i, b in enumerate(merged, 1)], columns=[page, "pos", *fields])

    kind = dict(rounds.dtypes)[page]
    return rounds.select(page, number, "pos", *fields).groupBy(page).applyInPandas(fold, f"{page} {kind}, pos int, {schema}")


def rows_of_conversations(conversations: DataFrame) -> DataFrame:
    """Turns as rounds of a page, their lines as paragraphs."""
    lines = conversations.select("conv_id", "turn", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\n|(?<=\.) ")).alias("pos", "text"))
    return lines.select("conv_id", "turn", "pos", F.lit("paragraph").alias("type"), "text")
