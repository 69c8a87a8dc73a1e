from __future__ import annotations

import random
import time

from leafmill.sources.html_nodes import CONTAINERS, FALLBACK_ROOTS, SELECTED, node_rows
from leafmill.sources.page_content import LEAST_SCORE, PER_BLOCK, PER_MEDIA, _key, absolute, block_of, content_of, page_content


def brute(nodes, base):
    """Each area by itself: all elements in it are looked at."""

    def shown(r):
        found = {}
        for i, (pre, _, _, tag, attrs, text, own, block_below, content_below, visible, _, known, leaf) in enumerate(nodes):
            container = tag in CONTAINERS
            if not (r[0] <= pre <= r[1] and visible and tag in SELECTED) or (container and (block_below or (not own and content_below))):
                continue
            if container and pre != r[0] and max(known, leaf) >= r[0]:
                continue
            block = block_of(tag, attrs, text, base)
            if block:
                found.setdefault(_key(block), block)
        blocks = list(found.values())
        return sum(len(" ".join((b[2] or b[4] or "").split())) + PER_BLOCK + PER_MEDIA * (b[0] in ("image", "video")) for b in blocks), len(blocks), blocks

    seen = [r for r in nodes if r[9]]
    for rank in range(14):
        first = next((r for r in seen if rank in r[10]), None)
        if first and (s := shown(first))[0] > LEAST_SCORE and s[1] > 1:
            return s
    wide = [shown(r) for r in seen if r[3] in FALLBACK_ROOTS]
    return max((s for s in wide if s[0] > LEAST_SCORE), key=lambda s: s[0], default=None)


def test_areas_against_brute_force():
    rnd = random.Random(4)
    tags = ("div", "div", "section", "span", "p", "li", "blockquote", "a href=/x", "h2", "article", "main", "div class=content", "div hidden", "p style='opacity:0'", "pre")

    def made(depth):
        out = ""
        for _ in range(rnd.randint(0, 4)):
            tag = rnd.choice(tags)
            inside = made(depth - 1) if depth and rnd.random() < 0.7 else rnd.choice(("", "some words", "more words than before, enough of them", f"n{rnd.randint(0, 9)}"))
            out += rnd.choice(("", "tail", '<img src="a/../b.png" alt=x>', "<video src=v.mp4></video>")) + f"<{tag}>{inside}</{tag.split()[0]}>"
        return out

    found = 0
    for _ in range(400):
        nodes = node_rows(made(5))
        got, want = content_of(nodes, "https://e.com/d/p"), brute(nodes, "https://e.com/d/p")
        assert got == want
        found += got is not None
    assert found > 100


def test_deep_pages_take_time_in_proportion():
    words = "word " * 40
    for inside in ("<div>" * 50_000 + words, "".join(f"<div><p>{words}{n}</p>" for n in range(5000)), "".join(f"<div>{words}{n}</div>" for n in range(20_000))):
        start = time.perf_counter()
        score, n_blocks, blocks = page_content(f"<div>{inside}", "")
        assert len(blocks) == n_blocks and score > 120 and time.perf_counter() - start < 20


def test_addresses():
    base = "https://e.com/a/b?q#f"
    for href, want in (
        ("", ""), ("x", "https://e.com/a/x"), ("/x", "https://e.com/x"), ("//o/x", "https://o/x"), ("?z", "https://e.com/a/b?z"), ("#z", "https://e.com/a/b?q#z"), ("mailto:x", "mailto:x"),
        ("../../../z/./w?a=../b", "https://e.com/z/w?a=../b"), ("http://h/a/../b", "http://h/b"), ("/q/..", "https://e.com/"), ("a/b/../..", "https://e.com/a/"),
    ):
        assert absolute(href, base) == want
    assert absolute("x", "https://e.com") == "https://e.com/x"
