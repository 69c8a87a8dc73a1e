from __future__ import annotations

import functools
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import pfor


@given(st.lists(st.one_of(st.integers(0, 2**32 - 1), st.integers(0, 300)), max_size=400), st.integers(1, 64))
@settings(max_examples=150, deadline=None)
def test_round_trip(values, block):
    v = np.array(values, "<u4")
    packed = pfor.pack_segment(v, block)
    assert (pfor.unpack_segment(packed) == v).all()
    a, b = len(v) // 3, len(v) // 2
    assert (pfor.unpack_segment(packed, a, b - a) == v[a:b]).all()


def test_outliers_are_exceptions():
    v = np.array([7] * 1000 + [2**31] * 24, "<u4")
    assert len(pfor.pack_block(v)) < 200


@functools.cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(pfor.default_path())


def ids_of(text):
    return library().encode(text or "", add_special_tokens=False).ids + [pfor.END_ID]


def test_files(docs, monkeypatch):
    monkeypatch.setattr(pfor, "SEGMENT", 64)
    rows = [(5, "Hello  World\n\nagain"), (-3, None), (2, ""), (9, "word " * 5000), (4, chr(0x301) + " a" + chr(0x1C) + "b <|endoftext|>" + chr(0x3A3))] + [(100 + i, f"text {i} of many") for i in range(60)]
    segments = pfor.write_ids(docs(rows, more=("payload", "part")))
    assert segments.where("payload is null").count() == 0
    got = sorted(tuple(r) for r in pfor.read_ids(segments).collect())
    at, want = 0, []
    for i, t in sorted(rows):
        ids = ids_of(t)
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want


def test_encoder_forgets(monkeypatch):
    """Equal to the library, with few remembered words and few bytes at a time, for marks, contractions and other scripts."""
    import random

    monkeypatch.setattr(pfor, "REMEMBERED", 40)
    encoder, rng = pfor.Encoder(pfor.default_path()), random.Random(5)
    parts = [*"ab\u00e9,.;:!? \n\tA's\u0130\u00df\u00ff\u03a3\u0301\u03070<|>\u00aa\u00b5\u0141\u4e2d", "<|endoftext|>", "it's ", "don't, ", "...", "word, ", "\u00dcn\u00ef. "]
    for _ in range(60):
        texts = [None, *("".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(50))]
        values, lengths = encoder.encode_many(texts)
        want = [ids_of(t)[:-1] for t in texts]
        assert lengths.tolist() == [len(w) for w in want] and values.tolist() == [i for w in want for i in w]


def test_registered_query(spark, tmp_path):
    """Every row of the query against the library, over a whole table."""
    from llm_data import SF

    from leafmill.llm.queries import op2_pfor_ids

    got = sorted(tuple(r) for r in op2_pfor_ids(spark, SF).collect())
    at, want = 0, []
    for row in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect():
        ids = ids_of(row.text)
        want.append((row.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want


def test_edges(docs):
    assert pfor.read_ids(pfor.write_ids(docs([]))).count() == 0
    got = pfor.read_ids(pfor.write_ids(docs([(1, "a"), (1, "a"), (None, "b")]))).orderBy("start").collect()
    assert [(r.doc_id, r.n_tokens) for r in got] == [(1, 2), (1, 2), (None, 2)] and [r.start for r in got] == [0, 2, 4]
