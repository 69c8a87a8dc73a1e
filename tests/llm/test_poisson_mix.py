from __future__ import annotations

import hashlib
import math

from leafmill.llm import poisson_mix


def draw(rate, seed, doc_id, part=1):
    u = int(hashlib.md5(f"{seed}:{doc_id}:{part}".encode()).hexdigest()[:13], 16) / 2**52
    n, p, total = 0, math.exp(-rate), math.exp(-rate)
    while total <= u:
        n += 1
        p *= rate / n
        total += p
    return n


def test_against_brute_force(docs):
    rows = [(i, f"t{i}", "en", ("big", "big", "big", "small", None)[i % 5]) for i in range(500)]
    out = poisson_mix.poisson_mix(docs(rows), weights={"big": 1.0, "small": 3.0}, total=800).collect()
    n = {"big": 300, "small": 100}
    want = {i: draw({"big": 0.25, "small": 0.75}[s] * 800 / n[s], poisson_mix.SEED, i) if s else 0 for i, _, _, s in rows}
    got = {}
    for r in out:
        got.setdefault(r.doc_id, []).append(r.copy_no)
        assert r.repeats == want[r.doc_id]
    assert {i: list(range(1, k + 1)) for i, k in want.items() if k} == {i: sorted(c) for i, c in got.items()}
    assert sorted(r.position for r in out) == list(range(len(out)))
    keys = [hashlib.md5(f"{poisson_mix.SEED}:{r.doc_id}:{r.copy_no}".encode()).hexdigest() for r in sorted(out, key=lambda r: r.position)]
    assert keys == sorted(keys)


def test_high_rates(docs, monkeypatch):
    monkeypatch.setattr(poisson_mix, "MOST_RATE", 20.0)
    rows = [(i, "t", "en", "s") for i in range(40)]
    out = poisson_mix.poisson_mix(docs(rows), total=40 * 50).collect()
    assert {r.doc_id: r.repeats for r in out} == {i: sum(draw(50 / 3, poisson_mix.SEED, i, part) for part in (1, 2, 3)) for i in range(40)}


def test_edges(docs):
    assert poisson_mix.poisson_mix(docs([])).count() == 0
    rows = [(None, None, None, None), (1, "a", "en", "s"), (1, "a", "en", "s"), (2, "", "en", "s"), (3, "z" * 100_000, "en", "s")]
    out = poisson_mix.poisson_mix(docs(rows, more=("position", "extra")), total=200).collect()
    assert sorted(r.position for r in out) == list(range(len(out))) and {r.extra for r in out} == {"x"}
    per = {}
    for r in out:
        per[r.doc_id] = per.get(r.doc_id, 0) + 1
    assert per[1] % 2 == 0 and None in per
    assert poisson_mix.poisson_mix(docs(rows), weights={}).count() == 0
