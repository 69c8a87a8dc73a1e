from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
from llm_data import SF

from leafmill.llm import periodic_runs
from leafmill.llm.queries import QUERIES


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0d]+", text or "") if w]


def brute(words):
    """All runs as (start, length, period), each lag scanned."""
    codes = {}
    x = np.array([codes.setdefault(w, len(codes)) for w in words], np.int64)
    found = {}
    for q in range(1, len(x) // 4 + 1):
        ends = np.flatnonzero(np.diff(np.concatenate([[0], (x[q:] == x[:-q]).astype(np.int8), [0]])))
        for s, e in zip(ends[::2].tolist(), ends[1::2].tolist()):
            if e - s + q >= max(6, 4 * q):
                found.setdefault((s, e - s + q), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def made(rnd):
    """Words with runs in them, in one another and side by side, some broken."""
    letters = rnd.choice(("ab", "abc", "abcdefgh", [str(n) for n in range(500)]))
    words = []
    for _ in range(rnd.randint(0, 5)):
        part = [rnd.choice(letters) for _ in range(rnd.choice((1, 2, 3, 5, 17, 18, 19, 25, 40, 77)))]
        if rnd.random() < 0.4:
            part = part[: len(part) // 3 + 1] * 4 + part
        part = part * rnd.randint(1, 6) + part[: rnd.randint(0, len(part))]
        if rnd.random() < 0.2:
            part[rnd.randrange(len(part))] = "odd"
        words += part
    return words


def test_fuzz():
    rnd = random.Random(5)
    for _ in range(60):
        docs = [made(rnd) for _ in range(rnd.randint(0, 12))]
        codes = {}
        flat = np.array([codes.setdefault(w, len(codes)) for d in docs for w in d], np.int64)
        got = [tuple(r) for r in periodic_runs.find_runs(flat, np.array([len(d) for d in docs], np.int64)).tolist()]
        assert got == [(n, *run) for n, d in enumerate(docs) for run in brute(d)]


def test_each_period_at_its_least_length():
    """Runs of four periods exactly, up to long ones, at the head, at the end and inside."""
    docs = []
    for q in [*range(1, 140), 500, 1999]:
        run = ([f"q{k}" for k in range(q)] * 6)[: max(6, 4 * q)]
        docs += [run, ["a", "b", *run], [*run, "a", "b"], ["a", *run, "b", "a"], run[:-1]]
    codes = {}
    flat = np.array([codes.setdefault(w, len(codes)) for d in docs for w in d], np.int64)
    got = [tuple(r) for r in periodic_runs.find_runs(flat, np.array([len(d) for d in docs], np.int64)).tolist()]
    want = []
    for n, d in enumerate(docs):
        q, form = sum(w.startswith("q") for w in set(d)), n % 5
        if form < 4:
            want.append((n, (0, 2, 0, 1)[form], max(6, 4 * q), q))
    assert got == want


def test_long_text_is_linear():
    words = ["a", "b"] * 200_000 + [str(n % 5003) for n in range(300_000)] + ["c"] * 100_000 + [str(n) for n in range(200_000)]
    codes = {}
    flat = np.array([codes.setdefault(w, len(codes)) for w in words], np.int64)
    got = periodic_runs.find_runs(flat, np.array([len(words)], np.int64)).tolist()
    assert got == [[0, 0, 400_000, 2], [0, 400_000, 300_000, 5003], [0, 700_000, 100_000, 1]]


def test_edges(docs):
    assert periodic_runs.periodic_runs(docs([])).count() == 0
    texts = [None, "", " \n", "a a a a a", "a a a a a a", "\x0ba\tb a  b a b\na b\x1fa b a b", "x " * 50_000, "é é é é é é é"]
    rows = [(n, t) for n, t in enumerate(texts)] + [(None, "a a a a a a b"), (None, "a a a a a a b")]
    out = periodic_runs.periodic_runs(docs(rows, more=("runs", "Collapsed_Text", "start", "extra")))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "start", "extra", "runs", "collapsed_text"]
    found = out.collect()
    assert len(found) == len(rows)
    for r in found:
        words = words_of(r.text)
        assert [tuple(x) for x in r.runs] == brute(words) and r.collapsed_text == collapsed(words, brute(words))


def test_query(spark, duck):
    want = []
    for i, text in duck.execute("select doc_id, text from documents").fetchall():
        words, h = words_of(text), zlib.crc32(str(i).encode())
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = brute(words)
        s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want.append((i, len(runs), s, n, q, n and 1000 * n // q, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(collapsed(words, runs))))
    got = QUERIES["op11_periodic_runs"](spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and any(w[1] for w in want)
