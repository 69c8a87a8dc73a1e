from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from leafmill.llm import divide_skip as D
from leafmill.llm.components import connected_components
from leafmill.llm.shingles import shingle_sets


def plain_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def brute(rows, k, num, den):
    """Shingles, component and links of each row; rows with a null id apart."""
    live = [(i, plain_set(t, k)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in live}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = Counter()
    for a in range(len(live)):
        for b in range(a):
            (i, x), (j, y) = live[a], live[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                links[a] += 1
                links[b] += 1
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    return sorted((i, len(s), root(i), links[a]) for a, (i, s) in enumerate(live))


def family(seed, n_groups=40):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(n_groups):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([1, 3, 4, 5, 8, 12, 20, 40, 120, 300]))]
        for _ in range(rnd.choice([1, 1, 2, 5])):
            d = list(base)
            for _ in range(rnd.randint(0, max(1, len(d) // 25))):
                i = rnd.randrange(len(d))
                d[i : i + rnd.choice([0, 1])] = [rnd.choice(vocab)]
            text = rnd.choice([" ", "\n", "\x0b"]).join(d)
            texts.append(text.upper() if rnd.random() < 0.1 else text)
    return texts


@pytest.mark.parametrize("k, num", [(4, 85), (5, 80)])
def test_first_shingles_and_search_lose_no_link(k, num):
    rule, texts = D.Threshold(num, 100), family(3, 60)
    sets = shingle_sets([t.encode() for t in texts], k)
    plain = [plain_set(t, k) for t in texts]
    assert [len(s) for s in sets] == [len(s) for s in plain]
    every, counts = np.unique(np.concatenate(sets), return_counts=True)
    some = counts > 2
    firsts = [[set(rule.prefix(s, *late).tolist()) for s in sets] for late in ((every[:0], counts[:0]), (every[some], counts[some]))]
    want = set()
    for i, a in enumerate(plain):
        for j in range(i):
            if 100 * len(a & plain[j]) >= num * len(a | plain[j]):
                want.add((j, i))
                assert all(own[i] & own[j] for own in firsts)
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), i))
    got = {tuple(sorted((order[x], order[y]))) for x, y in D.search([len(sets[i]) for i in order], [sets[i] for i in order], None, rule)}
    assert got == want


@pytest.mark.parametrize("sides", [False, True])
def test_components_without_all_links(sides):
    """With Together, the components are those of all links, also where some sets are known to be in one already."""
    rnd = random.Random(8)
    for seed in range(12):
        texts = family(seed, 12)
        rule, sets = D.Threshold(80, 100), shingle_sets([t.encode() for t in texts], 4)
        sets = sorted((s for s in sets if len(s)), key=len)
        sizes, side = [len(s) for s in sets], [rnd.randrange(2) for _ in sets] if sides else None
        labels = [rnd.choice([i, i, i // 7]) for i in range(len(sets))]

        def components(pairs):
            own = {x: {y for y in range(len(labels)) if labels[y] == labels[x]} for x in range(len(labels))}
            for x, y in pairs:
                if y not in own[x]:
                    both = own[x] | own[y]
                    for z in both:
                        own[z] = both
            return own

        full = list(D.search(sizes, sets, side, rule))
        few = list(D.search(sizes, sets, side, rule, D.Together(np.array(labels))))
        assert components(full) == components(few) and set(few) <= set(full)


def test_chained_pairs_fall_apart(docs, monkeypatch):
    """Pairs of near copies that only share a passage with the next pair: more than a block of them, and no link is lost."""
    monkeypatch.setattr(D, "BLOCK", 4)
    monkeypatch.setattr(D, "SAMPLE", 0)
    sizes = []
    parted = D._parted
    monkeypatch.setattr(D, "_parted", lambda rows, members, *rest: sizes.append(members.groupBy("grp").count().toPandas()["count"].max()) or sizes.append((out := parted(rows, members, *rest)).groupBy("grp").count().toPandas()["count"].max()) or out)
    rows = []
    for i in range(40):
        own = [f"p{i}x{j}" for j in range(60)] + [f"s{i // 2}y{j}" for j in range(12)] + [f"z{(i + 1) // 2}y{j}" for j in range(12)]
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join([*own[:30], "edit", *own[31:]]))]
    rows += rows[:6]  # repeated rows
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in D.jaccard_join(docs(rows)).collect())
    assert got == brute(rows, 4, 85, 100)
    assert sizes[0] > 4 >= sizes[1]


def test_packed_members():
    rows = [(5, 2, 5, np.array([1, 9, 2**63], np.uint64)), (-7, 1, 5, np.array([9], np.uint64)), (8, 1, 8, np.array([2, 9], np.uint64))]
    assert [(a, b, c, s.tolist()) for a, b, c, s in D.unpack_members(D.pack_members(rows))] == [(a, b, c, s.tolist()) for a, b, c, s in rows]


def test_thresholds_are_exact():
    rule = D.Threshold(85, 100)
    for m in range(1, 60):
        for n in range(m, 80):
            least = next(c for c in range(n + m + 1) if 100 * c >= 85 * (m + n - c))
            assert rule.overlap(m, n) == least
            if least <= m:
                assert rule.least(n) <= m and least >= max(rule.least(m), rule.least(n))


@pytest.mark.parametrize("block", [512, 3])
def test_against_brute_force(docs, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK", block)
    monkeypatch.setattr(D, "SLICE_ROWS", 7)
    texts = family(7) + ["", None, "  ", "one", "One", "a b", "A\tb"]
    rows = [(100 + 3 * i, t) for i, t in enumerate(texts)] + [(5, texts[0]), (100, texts[0])]
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in D.jaccard_join(docs(rows, more=("rep", "parts"))).collect())
    assert got == brute(rows, 4, 85, 100)
    alone = sorted((r.doc_id, r.n_shingles, r.component_id) for r in D.jaccard_join(docs(rows), links=False).collect())
    assert alone == [g[:3] for g in got]


def test_edges(docs):
    assert D.jaccard_join(docs([])).count() == 0
    rows = [(None, "a b c d e"), (None, "a b c d e"), (1, "a b c d e"), (2, "w " * 50_000), (3, "w " * 50_000)]
    got = sorted(((r.doc_id or 0), r.n_shingles, r.component_id, r.n_links, r.is_first) for r in D.jaccard_join(docs(rows)).collect())
    assert got == [(0, 2, None, 0, False), (0, 2, None, 0, False), (1, 2, 1, 0, True), (2, 1, 2, 1, True), (3, 1, 2, 1, False)]


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(70)] + [(7, 7)]
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a != b:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for i in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_digest_depends_on_the_set_alone():
    a = np.array([3, 5, 9], np.uint64)
    assert D.digest(a) == D.digest(a[::-1].copy()) != D.digest(a[:2])


def test_registered_query(spark):
    """Every row of the query against brute force, over a whole table."""
    from llm_data import SF

    from leafmill.llm.queries import op6_jaccard_join

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in op6_jaccard_join(spark, SF).collect()) == brute(rows, 4, 85, 100)
