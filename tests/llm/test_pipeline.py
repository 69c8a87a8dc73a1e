from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import corpus_pipeline as P
import pyarrow as pa
from leafmill.llm import poisson_mix, segment_bpe, string_kernel
from leafmill.llm.common import DOCUMENT_COLUMNS
from test_divide_skip import brute


def plain(rows, kept_by_language):
    rows = [r for r in rows if r["doc_id"] in kept_by_language]
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0d]", "", r["text"] or "")].append(r)
    rows = [min(g, key=lambda r: (-len(r["text"] or ""), r["doc_id"])) for g in groups.values()]
    firsts = {i for i, _, c, _ in brute([(r["doc_id"], r["text"]) for r in rows], P.WORDS, P.SIMILARITY, 100) if i == c}
    rows = [r for r in rows if r["doc_id"] in firsts]
    counts = Counter(r["source"] for r in rows)
    wanted = {s: round(math.sqrt(n) * 1e6) for s, n in counts.items()}
    out = Counter()
    for r in rows:
        rate = wanted[r["source"]] / sum(wanted.values()) * len(rows) / counts[r["source"]]
        u = int(hashlib.md5(f"{poisson_mix.SEED}:{r['doc_id']}:1".encode()).hexdigest()[:13], 16) / 2**52
        n, p, total = 0, math.exp(-rate), math.exp(-rate)
        while total <= u:
            n, p = n + 1, p * rate / (n + 1)
            total += p
        if n:
            out[r["doc_id"]] = n
    return out


def test_run_against_a_plain_version(spark):
    from llm_data import SF
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    model = string_kernel.train(docs)
    kept = {r.doc_id for r in string_kernel.identify(docs, model).collect() if r.lang_pred != "und" and r.score >= P.LEAST_SCORE}
    assert len(kept) == len(rows)  # every document there has a language
    library = Tokenizer.from_file(segment_bpe.default_path())
    out = P.run(spark, SF).collect()
    assert Counter(r.doc_id for r in out) == plain(rows, kept)
    texts = {r["doc_id"]: r["text"] for r in rows}
    assert all(r.round_trip and list(r.ids) == library.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids) for r in out)


def test_stages_keep_the_columns(spark, docs):
    rows = [(1, "the cat sat on the mat today", "en"), (2, None, "en"), (3, "12 34", "en"), (4, "the cat sat on the mat  today", "en"), (5, "", None), (None, "a dog", "en")]
    df = docs(rows)
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, df, "").columns == list(DOCUMENT_COLUMNS), name
        assert stage(spark, df.limit(0), "").count() == 0, name
    assert {r.doc_id for r in P.exact_dedup(spark, df, "").collect()} == {2, 3, 4, None}
    assert P.STAGES[-1][1](spark, df, "").count() == len(rows)
    assert [n for n, _ in P.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "bpe"]


def test_near_dedup_links_at_four_fifths(spark, docs):
    words = [f"w{i}" for i in range(24)]
    texts = [" ".join(words), " ".join(words[:22] + ["x", "y"]), " ".join(["a", "b", "c"] + words[3:])]  # 18 of 22 and 17 of 23 shingles of the first
    kept = {r.doc_id for r in P.near_dedup(spark, docs(texts), "").collect()}
    assert kept == {0, 2} == {i for i, _, c, _ in brute(list(enumerate(texts)), 5, 80, 100) if i == c}


def test_stages_send_small_batches(spark, docs):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, most = spark.conf.get(name), P.ARROW_ROWS
    try:
        for stage in (P.language_id, P.near_dedup, P.bpe):
            spark.conf.unset(name)
            stage(spark, docs([(1, "a text")]), "")
            sizes = spark.range(0, 3 * most, 1, 1).mapInArrow(lambda batches: (b.slice(0, 1).set_column(0, "id", pa.array([b.num_rows])) for b in batches if b.num_rows), "id long").collect()
            assert len(sizes) == 3 and {r.id for r in sizes} == {most}
        spark.conf.set(name, 10)  # a smaller one stays
        P.small_batches(spark)
        assert spark.conf.get(name) == "10"
    finally:
        spark.conf.set(name, before)


def test_offsets_need_no_python_worker(spark, monkeypatch):
    from leafmill.llm import common

    made = []
    monkeypatch.setattr(common, "local_rows", lambda *a, f=common.local_rows: made.append(f(*a)) or made[-1])
    found = poisson_mix.poisson_mix(spark.createDataFrame([(i, "t", "s") for i in range(50)], "doc_id long, text string, source string")).collect()
    assert sorted(r.position for r in found) == list(range(len(found)))
    assert len(made) == 1 and "Python" not in made[0]._jdf.queryExecution().toRdd().toDebugString()
    schema = made[0].schema
    assert common.local_rows(spark, [], schema).collect() == [] and common.local_rows(spark, [], schema).schema == schema
    assert "Python" in spark.createDataFrame([(1, 2)], schema)._jdf.queryExecution().toRdd().toDebugString()
