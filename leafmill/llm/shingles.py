"""Word shingles of whole texts as sorted arrays of 64-bit hashes, worked out for many texts at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
#: Bytes of text that are hashed at a time; a longer text is hashed alone.
CHUNK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.Generator(np.random.PCG64(4)).integers(0, 1 << 64, 256, dtype=np.uint64, endpoint=False)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """The SplitMix64 finaliser."""
    with np.errstate(over="ignore"):
        x = x + U((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    with np.errstate(over="ignore"):
        for base in (_BASE, _BASE_INVERSE):
            p = np.full(n, U(base), np.uint64)
            p[0] = U(1)
            out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its runs of k words; with fewer words one hash of all, with none none.

    Words are runs of bytes other than 0x20 and 0x09-0x0D, A-Z in lower case.
    """
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        to, size = at + 1, len(texts[at])
        while to < len(texts) and size + len(texts[to]) < CHUNK:
            size += len(texts[to])
            to += 1
        out += _sets(texts[at:to], k)
        at = to
    return out


def _sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    starts_of_docs = np.cumsum([1] + [len(t) + 1 for t in texts])
    space = _SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    first, last = edges[::2], edges[1::2]
    if not len(first):
        return [np.empty(0, np.uint64)] * len(texts)
    n = len(data)
    up, down = _powers(CHUNK + 4096) if n <= CHUNK + 4096 else _powers(n)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_TABLE[_LOWER[data]] * up[:n], dtype=np.uint64)))
        words = mix((sums[last] - sums[first]) * down[first], 1)
        runs = words[: max(0, len(words) - k + 1)]
        for j in range(1, k):
            runs = mix(runs, 2) * U(3) + words[j : len(words) - k + 1 + j]
        runs = mix(runs, 3)
    bounds = np.searchsorted(first, starts_of_docs)
    sets = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= k:
            own = np.sort(runs[a : b - k + 1])
            new = np.empty(len(own), bool)
            new[0] = True
            np.not_equal(own[1:], own[:-1], out=new[1:])
            sets.append(own[new])
        elif b > a:
            with np.errstate(over="ignore"):
                h = np.full(1, U(b - a), np.uint64)
                for w in words[a:b]:
                    h = mix(h, 4) * U(3) + w
                sets.append(mix(h, 5))
        else:
            sets.append(np.empty(0, np.uint64))
    return sets
