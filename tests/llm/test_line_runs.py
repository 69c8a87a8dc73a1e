from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest
from llm_data import SF

from leafmill.llm import line_runs
from leafmill.llm.queries import QUERIES
from leafmill.llm.sql import ORACLES

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_chars=20, min_docs=3):
    holders = defaultdict(set)
    key = lambda line: line.strip(SPACE).translate(LOWER)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    top = {k: max(ids, key=lambda i: (i is not None, i or 0)) for k, ids in holders.items() if len(ids) >= min_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if key(line) not in top or top[key(line)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def rows_of(found):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in found.collect()), key=str)


@pytest.mark.parametrize("most", [16 << 20, -1])
def test_against_brute_force(docs, monkeypatch, most):
    monkeypatch.setattr(line_runs, "MOST_BROADCAST", most)
    rnd = random.Random(3)
    pool = [f"line number {k} of the common ones" for k in range(12)] + ["x" * 20, "x" * 19, "É" * 20, "é" * 20, " " + "n" * 19, "", " "]
    forms = (str.upper, str.title, lambda s: f" \t{s}\r", lambda s: s + "\x0c", lambda s: s)
    rows = []
    for i in range(120):
        lines = [rnd.choice(forms)(rnd.choice(pool)) for _ in range(rnd.randint(0, 6))] + [f"own line of the document {i // 2}"] * rnd.randint(0, 2)
        rows.append((i * 7 % 120, "\n".join(lines) if rnd.random() < 0.95 else None))
    rows += [(i, "the hot line that a third of all has\n" + "z" * 30_000) for i in range(200, 260)]
    assert rows_of(line_runs.dedup_lines(docs(rows))) == brute(rows)


def test_edges(docs, spark):
    assert line_runs.dedup_lines(docs([])).count() == 0
    hot = "a line that stands in many documents"
    # rows that share an id are one document; a null id comes before all others
    rows = [(5, hot), (5, hot + "\n" + hot), (4, hot), (None, hot), (None, "short\n" + hot), (2, "other " + hot), (1, "other " + hot)]
    assert rows_of(line_runs.dedup_lines(docs(rows))) == brute(rows)
    only_null = [(None, hot), (None, hot), (None, hot)]
    assert rows_of(line_runs.dedup_lines(docs(only_null))) == brute(only_null)
    more = line_runs.dedup_lines(docs(rows, more=("n_lines", "Kept_Text", "pos", "h1", "extra")), with_text=False)
    assert more.columns == ["doc_id", "lang", "source", "n_chars", "pos", "h1", "extra", "n_lines", "n_dropped", "kept_text"]
    assert rows_of(more) == brute(rows)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("leafmill_run")]


def test_runs_compact(docs, spark):
    runs = line_runs.SortedRuns(spark, 3)
    for n in range(5):
        runs.add(spark.createDataFrame([(1, 1, 2, 9 - n), (n, 7, 1, 9 - n)], "h1 long, h2 long, n_docs long, top long"))
    assert [name is not None for name in runs.levels] == [True, False, True]
    found = {(r.h1, r.h2): (r.n_docs, r.top) for r in runs.compacted().collect()}
    # the first compaction settles the key (1, 1): later batches don't add it
    assert found == {(1, 1): (4, 9)} | {(n, 7): (1, 9 - n) for n in range(5)}
    runs.close()


def test_a_batch_writes_one_table_at_most(docs, spark, monkeypatch):
    # two processes (chmod) are forked for each file: they were counted as memory of the executor
    tables, folders = [], []
    write, store = line_runs.SortedRuns._write, line_runs.store
    monkeypatch.setattr(line_runs.SortedRuns, "_write", lambda self, rows: tables.append(write(self, rows)) or tables[-1])
    monkeypatch.setattr(line_runs, "store", lambda df, label: folders.append((label, store(df, label))) or folders[-1][1])
    rows = [(i, f"a line that three documents hold {i % 40}\nand one that all of them hold") for i in range(120)]
    df = docs(rows).repartition(3)
    assert rows_of(line_runs.dedup_lines(df)) == brute(rows)
    assert len(tables) == line_runs.BATCHES - 1
    assert len(dict(folders)["line-keys"].inputFiles()) <= 3


def test_last_batch_is_compacted_with_all_runs(docs, spark):
    batch = lambda n: spark.createDataFrame([(1, 1, 1, 9 - n), (n, 7, 1, 9 - n)], "h1 long, h2 long, n_docs long, top long")
    for n_batches in range(1, 9):
        runs = line_runs.SortedRuns(spark, 3)
        for n in range(n_batches - 1):
            runs.add(batch(n))
        found = sorted((r.h1, r.h2, r.n_docs, r.top) for r in runs.compacted(batch(n_batches - 1)).collect())
        runs.close()
        # a run that settles the key (1, 1) is made of four batches, or none does
        assert found == sorted([(1, 1, min(n_batches, 4), 9)] + [(n, 7, 1, 9 - n) for n in range(n_batches)]), n_batches


def test_query(spark, duck):
    got = sorted(tuple(r) for r in QUERIES["op13_line_runs"](spark, SF).collect())
    assert got == sorted(duck.execute(ORACLES["op13_line_runs"]).fetchall())
    texts = duck.execute("select doc_id, text from documents").fetchall()
    assert got == sorted((i, n, d, hashlib.sha256(k.encode()).hexdigest()) for i, n, d, k in brute(texts))
