"""Collecting pages of all families as they are scrolled, with typed state and timers.

A page's state is a list of its blocks, a map from the keys of blocks to their places, and a row of counters, each kept and
written by itself: a round that shows nothing new writes the counters only, one that adds blocks at the end appends them. A
page ends by the policy of its family, or by a timer when no round of it has come for a while of event time. Rounds after the
end are no part of it; they are counted and come out as late rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.urls import POLICIES, STABLE_BOTTOM
from ..operators.merge import Fragments, key, merge_fragments, merge_ordered

#: The fields of a block in a round and in the state.
FIELDS = ("type", "text", "markdown", "level", "ordered", "depth", "src", "alt", "href", "source_id", "source_order")
BLOCK = "type string, text string, markdown string, level int, ordered boolean, depth int, src string, alt string, href string, source_id string, source_order double"
COUNTERS = "rounds int, idle int, n_blocks int, before int, after int, removed int, height double, last_ms long, late long, status string, seen string"
OUT = "kind string, round long, rounds int, n_blocks int, before int, after int, removed int, idle int, late long, status string"
#: The provider that keeps lists, maps and timers.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@dataclass(frozen=True)
class Policy:
    merge: str
    stable_rounds: int
    most_rounds: int | None
    strict: bool
    stable_bottom: bool


def policies(**changed: dict) -> dict[str, Policy]:
    """The families' policies; changed has fields of some (names with _ for -) to replace."""
    out = {}
    for name, mode, stable, most, strict, _ in POLICIES:
        fields = {"merge": mode, "stable_rounds": stable, "most_rounds": most, "strict": strict, "stable_bottom": name in STABLE_BOTTOM}
        out[name] = Policy(**fields | changed.get(name.replace("-", "_"), {}))
    return out


class PageCollector(StatefulProcessor):
    def __init__(self, by_family: dict[str, Policy], page: str, gap: timedelta) -> None:
        self.by_family, self.page, self.gap_ms = by_family, page, int(gap.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counters = handle.getValueState("counters", COUNTERS)
        self.blocks = handle.getListState("blocks", BLOCK)
        self.places = handle.getMapState("places", "key string", "place int")

    def _load(self) -> None:
        names = [c.split()[0] for c in COUNTERS.split(", ")]
        self.now = dict(zip(names, self.counters.get())) if self.counters.exists() else {"rounds": 0, "idle": 0, "n_blocks": 0, "before": 0, "after": 0, "removed": 0, "height": 0.0, "last_ms": None, "late": 0, "status": "running", "seen": None}
        self.held = [dict(zip(FIELDS, b)) for b in self.blocks.get()] if self.blocks.exists() else []
        self.known = {k[0]: (v[0] if v[0] >= 0 else None) for k, v in self.places.iterator()} if self.places.exists() else {}
        self.stored, self.stored_places = list(self.held), dict(self.known)

    def _save(self) -> None:
        row = lambda b: tuple(b.get(f) for f in FIELDS)
        old, new = list(map(row, self.stored)), list(map(row, self.held))
        if new[: len(old)] != old:
            self.blocks.put(new)
        elif len(new) > len(old):
            self.blocks.appendList(new[len(old) :])
        for k, place in self.known.items():
            if k not in self.stored_places or self.stored_places[k] != place:
                self.places.updateValue((k,), (-1 if place is None else place,))
        self.counters.update(tuple(self.now.values()))

    def _step(self, policy: Policy, blocks: list[dict], moved: bool, top: float, height: float) -> None:
        now, shown = self.now, len(self.held)
        now["rounds"] += 1
        if policy.merge == "ordered":
            self.held = merge_ordered(self.held, blocks)
        elif policy.merge == "latest":
            self.held = merge_fragments([blocks])
        else:
            fragments = Fragments(self.held, self.known)
            for block in blocks:
                fragments.add(block)
            self.held = fragments.out
        seen = json.dumps(blocks, sort_keys=True) if policy.strict else None
        changed = len(self.held) != now["n_blocks"] or (policy.strict and seen != now["seen"])
        # what the round read and what of it was known: the metrics of a round
        before = len(blocks) if policy.merge == "latest" else shown + len(blocks)
        now |= {"before": now["before"] + before, "after": now["after"] + len(self.held), "removed": now["removed"] + max(0, before - len(self.held)), "n_blocks": len(self.held), "seen": seen}
        bottom, grown = height - top <= 2, abs(height - now["height"]) > 2
        now["height"] = height
        if not policy.stable_bottom:
            now["idle"] = 0 if changed else now["idle"] + 1
            now["status"] = "bottom" if not moved else "idle" if now["idle"] >= policy.stable_rounds else "running"
        else:
            now["idle"] = 0 if changed or not bottom or (policy.strict and grown) else now["idle"] + 1
            limit = policy.most_rounds is not None and now["rounds"] >= policy.most_rounds
            now["status"] = "stable-bottom" if now["idle"] >= policy.stable_rounds else "round-limit" if limit else "running"

    def _row(self, page, kind: str, number: int | None) -> Row:
        now = self.now
        return Row(**{self.page: page}, kind=kind, round=number, rounds=now["rounds"], n_blocks=now["n_blocks"], before=now["before"], after=now["after"], removed=now["removed"], idle=now["idle"], late=now["late"], status=now["status"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        self._load()
        now = self.now
        for row in sorted(rows, key=lambda r: r["round"]):
            at = int(row["ts"].timestamp() * 1000)
            if now["status"] == "running" and now["last_ms"] is not None and at - now["last_ms"] > self.gap_ms:
                now["status"] = "timed-out"  # as its timer says, wherever batches are cut
            if now["status"] != "running":
                now["late"] += 1
                yield self._row(key[0], "late", row["round"])
                continue
            now["last_ms"] = at
            blocks = [{f: b[f] for f in FIELDS} for b in row["blocks"] or ()]
            self._step(self.by_family[row["family"]], blocks, bool(row["moved"]), float(row["scroll_top"]), float(row["max_scroll_top"]))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if now["status"] == "running":
            self.handle.registerTimer(now["last_ms"] + self.gap_ms + 1)
        self._save()
        yield self._row(key[0], "state", None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._load()
        if self.now["status"] == "running":
            self.now["status"] = "timed-out"
            self._save()
            yield self._row(key[0], "state", None)

    def close(self) -> None:
        pass


def collect_pages(rounds: DataFrame, by_family: dict[str, Policy] | None = None, page: str = "page_id", gap: timedelta = timedelta(hours=1), delay: str = "10 minutes") -> DataFrame:
    """For each page and micro-batch a row of kind "state" with its counters after it, and a row of kind "late" for each round
    that came after its end.

    rounds: a streaming table of page, family, round, ts, blocks (an array of structs with FIELDS), moved, scroll_top and
    max_scroll_top. The session keeps state by PROVIDER. Rounds of a page in one micro-batch are put in order in memory; the
    source's limit of files or bytes a trigger bounds them. Null blocks count as none. Rounds that share a number are taken in
    any order.
    """
    kind = rounds.schema[page].dataType.simpleString()
    timed = rounds.withWatermark("ts", delay).groupBy(page)
    return timed.transformWithState(PageCollector(by_family or policies(), page, gap), f"{page} {kind}, {OUT}", "Append", "EventTime")
