from __future__ import annotations

import json
import shutil
from datetime import timedelta

from data_dir import SF

from leafmill.functions.urls import POLICIES
from leafmill.plans import queries
from leafmill.streaming import page_collector


def plain_merge(mode, known, shown):
    """What texts of plain paragraphs come to, by the rules of each mode."""
    if mode == "latest":
        known = []
    if mode != "ordered" or not known:
        out = list(known)
        for t in shown:
            if t not in out:
                out.append(t)
        return out
    out = list(known)
    previous = None
    for n, t in enumerate(shown):
        if t not in out:
            after = next((s for s in shown[n + 1 :] if s in known), None)
            if after is not None and (previous is None or out.index(previous) < out.index(after)):
                out.insert(out.index(after), t)
            else:
                out.insert(out.index(previous) + 1 if previous is not None else len(out), t)
        previous = t
    return out


def expected(rows, policies, gap, delay):
    pages, newest = {}, max(r["ts"] for r in rows)
    for r in sorted(rows, key=lambda r: r["event_id"]):
        p = pages.setdefault(r["user_id"], {"known": [], "rounds": 0, "n": 0, "before": 0, "after": 0, "removed": 0, "idle": 0, "height": 0.0, "seen": None, "status": "running", "late": 0, "first": None, "at": None})
        policy = policies[POLICIES[r["user_id"] % 5][0]]
        if p["status"] == "running" and p["at"] and r["ts"] - p["at"] > gap:
            p["status"] = "timed-out"
        if p["status"] != "running":
            p["late"] += 1
            p["first"] = p["first"] if p["first"] is not None else r["event_id"]
            continue
        p["at"] = r["ts"]
        shown = [f"{r['event_type']} {r['ts'].hour % 4}", f"what comes again: {r['ts'].day}", r["event_type"]]
        height = 1500.0 if r["event_type"] == "view" else 1000.0
        top = 0.0 if r["event_type"] == "error" else height
        before = len(shown) + (0 if policy.merge == "latest" else len(p["known"]))
        p["known"] = plain_merge(policy.merge, p["known"], shown)
        n = len(p["known"])
        p["rounds"] += 1
        p["before"], p["after"], p["removed"] = p["before"] + before, p["after"] + n, p["removed"] + before - n
        seen = json.dumps(shown) if policy.strict else None
        changed = n != p["n"] or (policy.strict and seen != p["seen"])
        grown = abs(height - p["height"]) > 2
        p["n"], p["seen"], p["height"] = n, seen, height
        if policy.stable_bottom:
            p["idle"] = 0 if changed or height - top > 2 or (policy.strict and grown) else p["idle"] + 1
            p["status"] = "stable-bottom" if p["idle"] >= policy.stable_rounds else "round-limit" if policy.most_rounds and p["rounds"] >= policy.most_rounds else "running"
        else:
            p["idle"] = 0 if changed else p["idle"] + 1
            p["status"] = "bottom" if r["event_id"] % 37 == 0 else "idle" if p["idle"] >= policy.stable_rounds else "running"
    for p in pages.values():
        if p["status"] == "running" and p["at"] + gap < newest - delay:
            p["status"] = "timed-out"
    return {u: (p["rounds"], p["n"], p["before"], p["after"], p["removed"], p["idle"], p["status"], p["late"], p["first"]) for u, p in pages.items()}


def test_query(spark):
    """All pages of the table against a plain loop: merge modes, ends, late rounds and the counts of each round."""
    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/events.parquet").collect()]
    got = {r[0]: tuple(r)[1:] for r in queries.collector_policies(spark, SF).collect()}
    want = expected(rows, queries._POLICIES, timedelta(days=2), timedelta(hours=1))
    assert got == want
    assert len({w[6] for w in want.values()}) >= 3


def test_restart(spark, tmp_path):
    """Two files, with a stop between them and a new query from the checkpoint, come to what one run comes to."""
    events = spark.read.parquet(f"{SF}/events.parquet").orderBy("event_id").toPandas()
    source, more = tmp_path / "in", tmp_path / "more"
    cut = len(events) // 2
    for n, part in enumerate((events[:cut], events[cut:])):
        spark.createDataFrame(part).coalesce(1).write.parquet(str(more / str(n)))
    source.mkdir()
    before = spark.conf.get(page_collector.PROVIDER[0])
    spark.conf.set(*page_collector.PROVIDER)
    try:
        for n in (0, 1):
            for file in (more / str(n)).glob("*.parquet"):
                shutil.copy(file, source / f"{n}.parquet")
            stream = spark.readStream.schema(spark.read.parquet(f"{SF}/events.parquet").schema).parquet(str(source))
            found = page_collector.collect_pages(queries._scrolled(stream), queries._POLICIES, gap=timedelta(days=2), delay="1 hour")
            found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "marks")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(page_collector.PROVIDER[0], before)
    got = {}
    for r in spark.read.parquet(str(tmp_path / "out")).where("kind = 'state'").collect():
        got[r.page_id] = max(got.get(r.page_id, ()), (r.rounds, r.late, r.status != "running", r.n_blocks, r.before, r.after, r.removed, r.idle, r.status))
    want = expected([r.asDict() for r in spark.read.parquet(f"{SF}/events.parquet").collect()], queries._POLICIES, timedelta(days=2), timedelta(hours=1))
    assert {p: (g[0], *g[3:8], g[8], g[1]) for p, g in got.items()} == {p: w[:8] for p, w in want.items()}
