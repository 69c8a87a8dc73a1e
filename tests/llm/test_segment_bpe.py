from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import segment_bpe as S

BPE = S.load(S.default_path())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(S.default_path())


@given(st.lists(st.integers(0, 5), max_size=40), st.randoms())
@settings(max_examples=200, deadline=None)
def test_merges_against_a_plain_loop(symbols, rnd):
    shift, made, ranks = 8, [], {}
    for new in range(6, 40):
        pair = rnd.randrange(new) << shift | rnd.randrange(new)
        if pair not in ranks:
            ranks[pair] = len(made)
            made.append(new)
    plain = list(symbols)
    while True:
        best = min(((ranks[a << shift | b], i) for i, (a, b) in enumerate(zip(plain, plain[1:])) if a << shift | b in ranks), default=None)
        if best is None:
            break
        plain[best[1] : best[1] + 2] = [made[best[0]]]
    assert S.merge_pairs(list(symbols), ranks, made, shift) == plain


def test_against_the_library(library):
    rnd = random.Random(2)
    pool = [*" \n\t\r\x0b\x1c'<|>", chr(0x85), chr(0xA0), chr(0x3000), chr(0x1F600), chr(0x301), *"abcdeABIs12!?.,-", chr(0xE9), chr(0x65E5), "<|endoftext|>", "'ll", "don't"]
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 50))) for _ in range(3000)] + ["", "x" * 3000, "!" * 2000]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert BPE.encode(t) == ids
        assert BPE.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_columns(docs, library):
    rows = [(1, "Hello world"), (2, None), (3, ""), (4, "<|endoftext|>x"), (1, "Hello world"), (5, "z" * 200_000), (None, "n")]
    out = S.bpe_decode(S.bpe_encode(docs(rows, more=("ids", "decoded", "extra")))).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.decoded == (r.text or "") and list(r.ids) == library.encode(r.text or "", add_special_tokens=False).ids and r.extra == "x"
    assert S.bpe_decode(S.bpe_encode(docs([]))).count() == 0
