from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from leafmill.llm import content_sort


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), i))
    out = {}
    for norm, members in groups.items():
        keep = min(members)[1]
        for _, i in members:
            out[i] = (keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest())
    return out


def test_against_brute_force(docs, monkeypatch):
    monkeypatch.setattr(content_sort, "HOT", 20)
    rnd = random.Random(1)
    rows = [(i, rnd.choice(["a b", "ab ", "a\tb\nc", "abc", "", None, "é x", "x" * 50_000, "x" * 50_000 + " y"])) for i in range(200)]
    rows += [(1000 + i, "hot text" + " " * (i % 7)) for i in range(300)]
    for with_text in (True, False):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in content_sort.exact_dedup(docs(rows), with_text=with_text).collect()}
        assert got == brute(rows)


def test_edges(docs, spark):
    assert content_sort.exact_dedup(docs([])).count() == 0
    same = docs([(1, "a"), (1, "a"), (None, "a"), (2, "b")], more=("kept", "GROUP_SIZE", "extra"))
    out = content_sort.exact_dedup(same)
    assert sorted(out.columns) == sorted(["doc_id", "text", "lang", "source", "n_chars", "extra", "keep_id", "group_size", "kept", "text_sha256"])
    rows = out.orderBy("doc_id").collect()
    assert sum(r.kept for r in rows if r.text == "a") == 1 and {r.group_size for r in rows if r.text == "a"} == {3} and {r.keep_id for r in rows if r.text == "a"} == {1}
    null_ids = content_sort.exact_dedup(docs([(None, "q"), (None, "q")])).collect()
    assert sum(r.kept for r in null_ids) == 1 and {r.keep_id for r in null_ids} == {None}


def test_long_shared_openings(docs):
    rows = [(i, "x" * 500 + str(i % 5)) for i in range(50)]
    got = content_sort.exact_dedup(docs(rows)).groupBy("text").agg(F.countDistinct("keep_id").alias("n"), F.max("group_size").alias("g")).collect()
    assert len(got) == 5 and all(r.n == 1 and r.g == 10 for r in got)
