from __future__ import annotations

import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from leafmill.llm import queries
from leafmill.llm import string_kernel as S


def test_held_out_accuracy(spark):
    from llm_data import SF

    found = queries.op3_string_kernel(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    test = [r for r in found if r.held_out]
    assert sum(r.lang_pred == r.lang for r in test) / len(test) > 0.97 and all(0 <= r.score <= 1 for r in found)


def grams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    line = " " + " ".join(words) + " "
    return {line[i : i + n] for n in S.ORDERS for i in range(len(line) - n + 1)} if words else set()


def test_kernel_against_plain_sets():
    texts = ["Hello, World 42", "hello there world", "Gr\u00fc\u00dfe aus K\u00f6ln!", "...", "x"]
    rows, known = S._rows(texts)
    sets = [grams(t) for t in texts]
    assert known.tolist() == [bool(s) for s in sets]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if a and b:
                plain = len(a & b) / math.sqrt(len(a) * len(b))
                hashed = rows[i] @ rows[j] / math.sqrt(rows[i].sum() * rows[j].sum())
                assert abs(plain - hashed) < 0.05


def test_nystrom_is_ridge_regression_when_all_rows_are_landmarks():
    rng = np.random.default_rng(1)
    rows = (rng.random((12, S.DIMS)) < 0.02).astype(np.float32)
    labels = ["a", "b"] * 6
    model = S.fit([np.flatnonzero(r) for r in rows], labels, n_landmarks=12, ridge=1.0)
    unit = rows / np.sqrt(rows.sum(1, keepdims=True))
    k = (unit @ unit.T).astype(float)
    y = np.where(np.array(labels)[:, None] == np.array(model.classes), 1.0, -1.0)
    center = np.eye(12) - 1 / 12
    alpha = np.linalg.solve(center @ k @ center + 12 / 100 * np.eye(12), y - y.mean(0))
    want = center @ k @ center @ alpha + y.mean(0)
    assert np.allclose(model.scores(rows), want, atol=0.02)


def test_eighty_languages(docs):
    """Every language is learned, however many there are and however rare it is."""
    rng = random.Random(3)
    languages = {}
    for n in range(80):
        syllables = ["".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou\u00e4\u00f6") for _ in range(2)) for _ in range(12)]
        languages[f"l{n:02}"] = lambda s=syllables: " ".join("".join(rng.choices(s, k=2)) for _ in range(30))
    rows = [(80 * i + n, make(), name) for i in range(40) for n, (name, make) in enumerate(languages.items())] + [(9000 + i, languages["l00"](), "l00") for i in range(2000)]
    df = docs(rows)
    model = S.train(df)
    assert model.classes == sorted(languages)
    found = S.identify(df, model).where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in found) / len(found) > 0.95
    (frequent, rare) = (sum(r.lang == r.lang_pred for r in own) / len(own) for own in ([r for r in found if r.lang == "l00"], [r for r in found if r.lang != "l00"]))
    assert min(frequent, rare) > 0.9


def test_edges(docs):
    train = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 20)]
    model = S.train(docs(train))
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "the dog"), (4, "the dog"), (None, "die katze"), (5, "der hund " * 20_000)]
    out = S.identify(docs(rows, more=("score", "extra")), model).collect()
    got = sorted((r.doc_id or 0, r.lang_pred) for r in out)
    assert got == [(0, "de"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (5, "de")]
    assert {r.score for r in out if r.lang_pred == "und"} == {0.0} and {r.extra for r in out} == {"x"} and [r.held_out for r in out if r.doc_id is None] == [False]
    assert S.train(docs([])) is None and S.identify(docs([]), model).count() == 0
    assert [r.lang_pred for r in S.identify(docs(["the"]), None).collect()] == ["und"]
    assert S.train(docs([(1, "a", None)])) is None


def test_language_is_no_input(docs):
    model = S.train(docs([(i, "the cat and", "en") for i in range(9)] + [(20 + i, "der hund und", "de") for i in range(9)]))
    one, other = ([(r.lang_pred, r.score) for r in S.identify(docs([(1, "the cat", lang, s)]), model).collect()] for lang, s in (("en", "a"), ("de", "b")))
    assert one == other


def test_held_out_expression(docs):
    assert docs([(i, "a") for i in range(50)]).where(S.held_out("doc_id") != (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)).count() == 0
