"""Collecting a page that loads as it is scrolled, as a stateful stream.

Each input row is a round of a page with the blocks that were seen. The state of a page is what was merged so far and for
how many rounds nothing changed; it ends by the policy of its site family, and later rounds of it count no more.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..operators.merge import merge_fragments, merge_ordered


@dataclass
class Policy:
    """mode: stable-bottom stops after idle rounds at the bottom, free after idle rounds or at the bottom."""

    merge: str = "ordered"
    stable_bottom: bool = False
    idle: int = 4
    most_rounds: int | None = None
    strict: bool = False


@dataclass
class State:
    blocks: list[dict] = field(default_factory=list)
    fragments: list[list[dict]] = field(default_factory=list)
    idle: int = 0
    count: int = 0
    rounds: int = 0
    seen: str | None = None
    height: float = 0.0
    status: str = "running"


def step(state: State, policy: Policy, blocks: list[dict], moved: bool = True, top: float = 0.0, height: float = 0.0) -> State:
    """The state after one more round; a page that has ended stays as it is."""
    if state.status != "running":
        return state
    state.rounds += 1
    if policy.merge == "ordered":
        state.blocks = merge_ordered(state.blocks, blocks)
    else:
        state.fragments = [blocks] if policy.merge == "latest" else [*state.fragments, blocks]
        state.blocks = merge_fragments(state.fragments)
    seen = json.dumps(blocks, sort_keys=True) if policy.strict else None
    changed = len(state.blocks) != state.count or (policy.strict and seen != state.seen)
    state.count, state.seen = len(state.blocks), seen
    bottom, grown = height - top <= 2, abs(height - state.height) > 2
    state.height = height
    if not policy.stable_bottom:
        state.idle = 0 if changed else state.idle + 1
        state.status = "bottom" if not moved else "idle" if state.idle >= policy.idle else "running"
    else:
        state.idle = 0 if changed or not bottom or (policy.strict and grown) else state.idle + 1
        state.status = "stable-bottom" if state.idle >= policy.idle else "round-limit" if policy.most_rounds and state.rounds >= policy.most_rounds else "running"
    return state


OUT = "rounds int, n_blocks int, idle int, status string, blocks string"


def collect(rounds: DataFrame, policy: Policy, page: str = "page_id") -> DataFrame:
    """A row for each page and micro-batch with its state after it: page, rounds, n_blocks, idle, status, blocks (JSON).

    rounds: a streaming table of page, round, blocks (JSON array), moved, scroll_top and max_scroll_top. The state of a
    page is one JSON string; a page that has ended keeps a short one.
    """
    kind = rounds.schema[page].dataType.simpleString()

    def update(group: tuple, batches: Iterable[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        state = State(**json.loads(held.get[0])) if held.exists else State()
        news = pd.concat(list(batches)).sort_values("round")
        for row in news.itertuples(index=False):
            state = step(state, policy, json.loads(row.blocks), bool(row.moved), float(row.scroll_top), float(row.max_scroll_top))
        if state.status != "running":
            state.fragments, state.seen = [], None
        held.update((json.dumps(asdict(state)),))
        yield pd.DataFrame({page: [group[0]], "rounds": [state.rounds], "n_blocks": [len(state.blocks)], "idle": [state.idle], "status": [state.status], "blocks": [json.dumps(state.blocks)]})

    return rounds.groupBy(page).applyInPandasWithState(update, f"{page} {kind}, {OUT}", T.StructType([T.StructField("state", T.StringType())]), "append", "NoTimeout")


def collect_batch(rounds: DataFrame, policy: Policy, page: str = "page_id") -> DataFrame:
    """The same over a finished table: one row for each page."""
    kind = rounds.schema[page].dataType.simpleString()

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        state = State()
        for row in pdf.sort_values("round").itertuples(index=False):
            state = step(state, policy, json.loads(row.blocks), bool(row.moved), float(row.scroll_top), float(row.max_scroll_top))
        return pd.DataFrame({page: [pdf[page].iloc[0]], "rounds": [state.rounds], "n_blocks": [len(state.blocks)], "idle": [state.idle], "status": [state.status], "blocks": [json.dumps(state.blocks)]})

    return rounds.groupBy(page).applyInPandas(fold, f"{page} {kind}, {OUT}")
