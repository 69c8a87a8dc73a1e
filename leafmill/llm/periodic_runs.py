"""Periodic runs of words, by multi-scale minimizers.

A run is a stretch of words with smallest period q and at least max(6, 4 q) words that can't be extended. Periods up to
MOST_LAG are scanned for directly: where words q apart are equal often enough in a row. Longer ones come in scales; that of
window w has the periods from its least one to w, where 3 w <= 4 q + 2 holds for each q. Its minimizers are the w-grams whose
hash is the least of the w places that begin with theirs or end with it. Inside a run of period q, the least w-gram of the
period stands q words on again, all of its places are minimizers and nothing between them is (the run has at least
2 w - 1 places, so one of the two windows lies in it). So equal neighbours among the minimizers, at a distance of the scale's
periods, meet each run; from each chain of them one is extended word by word, which also refutes equal hashes.

A slice of documents is one array, the longest first, parted by words of their own: a scale takes those at its head that are
long enough. Work grows with the number of words times the number of scales.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_table, releasing, slices, split_tokens

#: A run has at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Periods up to this are found by direct scans.
MOST_LAG = 16
SLICE, SLICE_ROWS = 2 << 20, 1 << 16
SEPARATORS = b" \t\n\x0b\x0c\r"

RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"
OUTPUT = ("runs", "collapsed_text")

#: Odd multipliers of the hash.
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SHIFT = np.uint64(29)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = (a * _A + b) * _B
    return out ^ (out >> _SHIFT)


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each width neighbours."""
    low, have = values, 1
    while 2 * have <= width:
        low, have = np.minimum(low[:-have], low[have:]), 2 * have
    n = len(values) - width + 1
    return np.minimum(low[:n], low[width - have : width - have + n])


def _by_lag(x: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the stretches of period lag that are long enough."""
    least = max(LEAST_WORDS, LEAST_PERIODS * lag) - lag
    hits = np.flatnonzero(x[lag:] == x[:-lag])
    ends = np.flatnonzero(np.diff(hits, append=-2) != 1)
    begins = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    sizes = ends - begins + 1
    good = sizes >= least
    return hits[begins[good]], sizes[good] + lag


def _extended(x: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The first and the last place, from at on both sides, up to which words lag apart are equal: [first, last)."""
    last, step = at, 4 * lag
    while True:
        n = min(step, len(x) - lag - last)
        odd = np.flatnonzero(x[last : last + n] != x[last + lag : last + lag + n])
        last += int(odd[0]) if len(odd) else n
        if len(odd) or n < step:
            break
        step *= 2
    first, step = at, 4 * lag
    while True:
        n = min(step, first)
        odd = np.flatnonzero(x[first - n : first] != x[first - n + lag : first + lag])
        first -= n - int(odd[-1]) - 1 if len(odd) else n
        if len(odd) or n < step:
            break
        step *= 2
    return first, last


def _seeds(values: np.ndarray, width: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances, from least to width, of neighbouring equal minimizers; of each chain of a distance the first."""
    if len(values) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = _window_minima(values, width)
    chosen = np.zeros(len(values), bool)
    chosen[: len(low)] = values[: len(low)] == low
    chosen[width - 1 :] |= values[width - 1 :] == low
    at = np.flatnonzero(chosen)
    gap = np.diff(at)
    good = (gap >= least) & (gap <= width) & (values[at[1:]] == values[at[:-1]])
    at, gap = at[:-1][good], gap[good]
    order = np.lexsort((at, gap))
    at, gap = at[order], gap[order]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (gap[1:] != gap[:-1]) | (at[1:] > at[:-1] + width)
    return at[fresh], gap[fresh]


def find_runs(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Rows (document, start, length, period), in this order, of all runs; codes has the documents' words one after another."""
    order = np.argsort(-counts, kind="stable")
    sizes = counts[order].astype(np.int64)
    heads = np.cumsum(sizes + 1) - sizes - 1  # of the documents in x, each with a separator after it
    x = np.full(int(sizes.sum()) + len(sizes), -1, np.int64)
    from_head = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    x[np.repeat(heads, sizes) + from_head] = codes[np.repeat((np.cumsum(counts) - counts)[order], sizes) + from_head]
    x[heads + sizes] = -1 - np.arange(len(sizes))
    # words of the documents that have at least n
    head_part = lambda n: int((sizes[sizes >= n] + 1).sum())

    found = []  # (starts in x, lengths, periods), short periods first
    for lag in range(1, MOST_LAG + 1):
        part = x[: head_part(max(LEAST_WORDS, LEAST_PERIODS * lag))]
        if len(part) <= lag:
            break
        starts, lengths = _by_lag(part, lag)
        found.append((starts, lengths, np.full(len(starts), lag)))
    least, grams, size = MOST_LAG + 1, _mixed(x.astype(np.uint64), np.uint64(1)), 1  # hashes of size words from each place
    while n := head_part(LEAST_PERIODS * least):
        width = (LEAST_PERIODS * least + 2) // 3
        while 2 * size <= width:
            grams, size = _mixed(grams[:-size], grams[size:]), 2 * size
        part = grams[: n - size + 1]
        places = max(0, n - width + 1)
        more = []
        for at, lag in zip(*(v.tolist() for v in _seeds(_mixed(part[:places], part[width - size : width - size + places]), width, least))):
            first, last = _extended(x[:n], at, lag)
            if last - first + lag >= LEAST_PERIODS * lag:
                more.append((first, last - first + lag, lag))
        found += [tuple(np.array(v, np.int64) for v in zip(*more))] if more else []
        least = width + 1
    starts, lengths, periods = (np.concatenate(v) for v in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    # a stretch that was met with multiples of its period counts once, with the smallest
    keys = np.lexsort((periods, lengths, starts))
    starts, lengths, periods = starts[keys], lengths[keys], periods[keys]
    first = np.ones(len(starts), bool)
    first[1:] = (starts[1:] != starts[:-1]) | (lengths[1:] != lengths[:-1])
    starts, lengths, periods = starts[first], lengths[first], periods[first]
    rank = np.searchsorted(heads, starts, "right") - 1
    runs = np.stack([order[rank], starts - heads[rank], lengths, periods], axis=1)
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def _slice_runs(texts: pa.Array, table: np.ndarray) -> tuple[pa.Array, pa.Array]:
    tokens, counts = split_tokens(texts, table)
    runs = find_runs(tokens.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), counts)
    heads = np.cumsum(counts) - counts
    if len(runs):
        doc, start, length, period = runs.T
        change = np.zeros(len(tokens) + 1, np.int64)
        np.add.at(change, heads[doc] + start + period, 1)
        np.add.at(change, heads[doc] + start + length, -1)
        kept = np.cumsum(change[:-1]) == 0
        tokens = tokens.filter(pa.array(kept))
        ends = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], np.cumsum(counts)])]
    else:
        ends = np.concatenate([[0], np.cumsum(counts)])
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tokens), " ")
    fields = pa.StructArray.from_arrays([pa.array(runs[:, k], pa.int64()) for k in (1, 2, 3)], names=["start", "length", "period"])
    ends = np.searchsorted(runs[:, 0], np.arange(len(counts) + 1))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), fields), collapsed


def periodic_runs(docs: DataFrame, text_col: str = "text", with_text: bool = True) -> DataFrame:
    """docs with runs, all runs of a document's words (start and length in words, period) by start and then period, and
    collapsed_text: its words, but for those that any run has after its first period, joined by one space.

    Words are maximal runs of characters outside [\\x20\\x09-\\x0D]. Nulls: a null text has no words, no runs and an empty
    collapsed_text. Ties: runs may overlap, and each counts. Repeated rows: each by itself. Very long texts: whole, a slice of
    their own. Empty table: empty result. Extra columns stay; one that has the name of an output column is replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in OUTPUT])
    columns = [c for c in docs.columns if with_text or c != text_col]
    kinds = docs.sparkSession.createDataFrame([], f"runs {RUN}, collapsed_text string").schema.fields
    schema = T.StructType([docs.schema[c] for c in columns] + kinds)
    table, names = byte_table(SEPARATORS), schema.names

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, 0, SLICE, SLICE_ROWS):
            yield pa.RecordBatch.from_arrays([*rows.columns[1:], *_slice_runs(rows.column(0), table)], names=names)

    return docs.select(F.col(text_col), *(F.col(c) for c in columns)).mapInArrow(lambda batches: releasing(found(batches)), schema)
