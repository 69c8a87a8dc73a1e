from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

from leafmill.llm import hilbert, queries


@pytest.mark.parametrize("n, bits", [(2, 3), (3, 2)])
def test_curve_visits_neighbours(spark, n, bits):
    """Each cell once, and each step of the curve goes to a cell beside the last one."""
    df = spark.range(1 << bits).withColumnRenamed("id", "a0")
    for k in range(1, n):
        df = df.crossJoin(spark.range(1 << bits).withColumnRenamed("id", f"a{k}"))  # a fixture of a few cells
    names = [f"a{k}" for k in range(n)]
    cells = [tuple(r[c] for c in names) for r in df.withColumn("h", hilbert.hilbert_index([F.col(c) for c in names], bits)).orderBy("h").collect()]
    assert len(set(cells)) == 1 << (n * bits)
    assert all(sum(abs(x - y) for x, y in zip(a, b)) == 1 for a, b in zip(cells, cells[1:]))


def test_shards(docs):
    texts = [None, "", "é", "same", "same", "y" * 90_000] + ["w " * (i % 60) for i in range(100)]
    rows = [(i, t, ("en", "de", None)[i % 3], ("hot" if i % 3 else f"s{i % 5}")) for i, t in enumerate(texts)] + [(7, "same", "en", "hot")] * 3
    out = hilbert.hilbert_shards(docs(rows, more=("shard", "extra")), 8).collect()
    assert len(out) == len(rows)
    by_shard = {}
    for r in out:
        by_shard.setdefault(r.shard, []).append(r)
        assert r.size == len((r.text or "").encode()) + 1
    counts = [len(by_shard[k]) for k in range(8)]
    assert max(counts) - min(counts) <= 1
    for rs in by_shard.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    order = [r.curve for k in range(8) for r in sorted(by_shard[k], key=lambda r: r.slot)]
    assert order == sorted(order)


def test_few_rows_and_none(docs):
    assert hilbert.hilbert_shards(docs([]), 8).count() == 0
    assert sorted((r.shard, r.slot) for r in hilbert.hilbert_shards(docs(["a", "b"]), 8).collect()) == [(0, 0), (4, 0)]


def placed(rows):
    """The rows in their order; shards, slots and equal texts checked."""
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r)
    counts = [len(own) for own in by_shard.values()]
    assert max(counts) - min(counts) <= 1 and all(sorted(r.slot for r in own) == list(range(len(own))) for own in by_shard.values())
    first = [-(-k * len(rows) // 8) for k in range(9)]
    assert all(len(by_shard[k]) == first[k + 1] - first[k] for k in by_shard)
    return [r for k in sorted(by_shard) for r in sorted(by_shard[k], key=lambda r: r.slot)]


@pytest.mark.parametrize("piece", [1, 300, 1 << 27])
def test_equal_texts_lie_together(docs, monkeypatch, piece):
    """Also where copies have other sources, where pieces are small, and where one text has a third of all rows."""
    monkeypatch.setattr(hilbert, "PIECE", piece)
    rows = [(i, "hot text", "en", f"s{i % 9}") for i in range(60)] + [(100 + i, f"text {i % 40}", ("en", "de", "fr")[i % 3], f"s{i % 7}") for i in range(120)]
    rows += [(None, None, None, None)] * 5 + [(500, "z" * 5000, "en", "s1")]
    order = placed(hilbert.hilbert_shards(docs(rows), 8).collect())
    assert len(order) == len(rows)
    curves = [r.curve for r in order]
    assert curves == sorted(curves)
    runs = [t for t, before in zip([r.text for r in order], [0, *(r.text for r in order)]) if t != before]
    assert len(runs) == len(set(runs))


def test_pruning(spark, docs):
    """A reader that asks for one language opens few shards, by the bounds of the manifest, and finds all its rows there."""
    from llm_data import SF

    sharded = hilbert.hilbert_shards(spark.read.parquet(f"{SF}/documents.parquet"), 8)
    m = hilbert.manifest(sharded)
    asked = m.where("lang_low <= 'es' and 'es' <= lang_high")
    opened = [r.shard for r in asked.collect()]
    assert m.count() == 8 and len(opened) < 8 and m.agg(F.sum("n_rows")).first()[0] == sharded.count()
    own = sharded.where(F.col("shard").isin(opened) & (F.col("lang") == "es"))
    assert own.count() == sharded.where("lang = 'es'").count()
    files = [f for f in own.inputFiles()]
    assert all("shard=" in f for f in files)


def test_names_keep_their_order(docs):
    df = docs([(i, "t", None, s) for i, s in enumerate(["b", "a", "zebra", "", None, "abc", "abd"])])
    cuts = hilbert.name_cuts(df, ("source",))[0]
    rows = df.select("source", hilbert.name_cell(F.col("source"), cuts).alias("c")).collect()
    ordered = sorted(rows, key=lambda r: (r.source is not None, r.source or ""))
    assert [r.c for r in ordered] == sorted(r.c for r in rows) and len({r.c for r in rows}) == 7


def test_query(spark):
    from llm_data import SF

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op4_hilbert_shards(spark, SF).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts.items()}
    order = placed(rows)
    assert [r.curve for r in order] == sorted(r.curve for r in rows) and {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}
    runs = [t for t, before in zip([texts[r.doc_id] for r in order], [0, *(texts[r.doc_id] for r in order)]) if t != before]
    assert len(runs) == len(set(runs))
