from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_data import SF

from leafmill.llm import common, hybrid_search
from leafmill.llm.queries import QUERIES
from leafmill.llm.sql import ORACLES

TERM = re.compile("[0-9A-Za-z]|[^\x00-\x7f]")


def terms_of(text):
    out, now = [], ""
    for c in (text or "") + " ":
        if TERM.match(c):
            now += c.lower() if c.isascii() else c
        elif now:
            out.append(now)
            now = ""
    return out


def brute(rows, items, k):
    docs = [(i, terms_of(t)) for i, t in rows]
    n_docs, n_terms = sum(bool(t) for _, t in docs), sum(len(t) for _, t in docs)
    df = Counter(t for _, terms in docs for t in set(terms))
    out = []
    for item, text in items:
        scored = []
        for i, terms in docs:
            tf = Counter(terms)
            score = 0
            for t in terms_of(text):
                if tf[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (1_000_000_000 * tf[t] // (1000 * tf[t] + 12 * (75 + 25 * len(terms) * n_docs // n_terms)))
            if score > 0:
                scored.append((-score, i is None, i))
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(scored[:k])]
    return sorted(out, key=str)


def rows_of(found):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in found.collect()), key=str)


def test_split_tokens():
    table = common.byte_table(hybrid_search.SEPARATORS, lower=True)
    texts = ["", None, "a", "b", "  Ab-c d", "x ", "éÉ_É", " ", "1a\x002b"]
    for at in (0, 2, 4, 9):
        tokens, counts = common.split_tokens(pa.array(texts, pa.string()).slice(at), table)
        assert list(counts) == [len(terms_of(t)) for t in texts[at:]]
        assert tokens.to_pylist() == [w for t in texts[at:] for w in terms_of(t)]


@pytest.mark.parametrize("slice_rows", [7, 1000])
def test_against_brute_force(docs, spark, monkeypatch, slice_rows):
    monkeypatch.setattr(hybrid_search, "SLICE_ROWS", slice_rows)
    rnd = random.Random(slice_rows)
    words = [f"w{n}" for n in range(60)] + ["É", "naïve"]
    shares = [1 / (n + 1) for n in range(len(words))]
    text = lambda most: rnd.choice((" ", "--", "\n")).join(rnd.choices(words, shares, k=rnd.randint(0, most))).title()
    rows = [(n // 2 if n % 9 else None, None if n % 31 == 5 else text(40)) for n in range(250)]
    rows += [(500 + n, "w3 w3 w7") for n in range(30)] + [(900, "w1 " * 20_000)]
    items = [(n % 25, text(12)) for n in range(28)] + [(30, None), (31, ""), (32, "unseen"), (33, "w3 w3 w3 w50")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    for k in (3, 20):
        assert rows_of(hybrid_search.rank_documents(docs(rows), asked, k=k)) == brute(rows, items, k)
    monkeypatch.setattr(hybrid_search, "ITEM_BYTES", 300)
    assert rows_of(hybrid_search.rank_documents(docs(rows), asked, k=5)) == brute(rows, items, 5)


def test_skipping_leaves_nothing_out():
    """A segment after another, the threshold rising: as if all documents were scored."""
    rnd = np.random.default_rng(1)
    best, everything = hybrid_search.Best(10), []
    for part in range(40):
        lengths = rnd.integers(30, 300, 200)
        tfs = rnd.poisson(rnd.gamma(0.3, 1, 12)[:, None] + np.zeros(200))
        terms = np.flatnonzero(tfs.any(1))
        places = [np.flatnonzero(tfs[t]) for t in terms]
        row = {"ids": np.arange(200) + 200 * part, "lengths": lengths, "terms": terms, "sizes": np.array([len(p) for p in places]), "places": np.concatenate(places), "tfs": np.concatenate([tfs[t][p] for t, p in zip(terms, places)])}
        segment = hybrid_search.Segment({n: pa.scalar(v.tolist(), pa.list_(pa.int64())) for n, v in row.items()}, 8000, 8000 * 165, 12)
        weights = np.array([9000, 7000, 5000, 3000, 900, 500, 300, 200, 90, 30, 3, 0])
        segment.search(np.arange(12), weights, best)
        m = 75 + 25 * lengths * 8000 // (8000 * 165)
        scores = (weights[:, None] * np.where(tfs > 0, 1_000_000_000 * tfs // (1000 * tfs + 12 * m), 0)).sum(0)
        everything += zip((-scores).tolist(), row["ids"].tolist())
    assert list(zip((-best.scores).tolist(), best.ids.tolist())) == sorted(everything)[:10]


def test_edges(docs, spark):
    asked = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    for d, i in ((docs([]), asked), (docs(["a b"]), none), (docs([None, "", "--"]), asked), (docs(["q"]), asked)):
        out = hybrid_search.rank_documents(d, i)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0
    same = hybrid_search.rank_documents(docs([(1, "a"), (1, "a"), (0, "b"), (2, None)], more=("score", "item_no", "ids")), asked)
    assert rows_of(same) == brute([(1, "a"), (1, "a"), (0, "b"), (2, None)], [(1, "a b")], 20)


def test_query(spark, duck):
    got = sorted(tuple(r) for r in QUERIES["op12_hybrid_search"](spark, SF).collect())
    assert got == sorted(duck.execute(ORACLES["op12_hybrid_search"]).fetchall())
    rows, items = (duck.execute(f"select * from {t}").fetchall() for t in ("(select doc_id, text from documents)", "(select item_id, text from benchmark)"))
    assert sorted(got, key=str) == brute(rows, items, 20)
