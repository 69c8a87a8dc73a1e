"""Ranked lexical search: term-at-a-time over short lists, document-at-a-time over long ones.

Each slice of documents becomes a segment: the inverted lists of the items' terms, documents ascending in each. Counts that
hold for all documents (N, L and each term's df) are summed over the stored segments. A task then searches its segments one
after another for all items. Of a segment, an item's short lists are summed term by term into accumulators; these are one
more iterator, with the largest sum as its bound, beside the long lists with their own bounds. Iterators that can't lift a
document to the item's threshold together, its k-th best score so far, only get probed by binary search, for documents that
the others have and while their bounds leave a chance; a segment all of whose bounds stay below is skipped. Nothing that
could be among the k best is left out. Tasks send k rows an item at most; windows merge them, in shares first.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_table, releasing, slices, split_tokens, store

TOP = 20
#: What parts terms: all of ASCII but digits and letters.
SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Bytes of text and rows of a segment; bytes of items that are searched for at a time.
SLICE, SLICE_ROWS, ITEM_BYTES = 8 << 20, 16_384, 8 << 20
#: A list is short if it has at most this share of its segment's documents.
SHORT = 1 / 16
#: Shares in which an item's rows are merged first.
SHARES = 32

SEGMENT = "n_docs long, n_terms long, ids array<long>, lengths array<long>, terms array<int>, sizes array<int>, places array<int>, tfs array<int>"
FOUND = "item_no int, doc_id long, score long"


def item_terms(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(LOWER))


def build_segments(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Segments of docs (id, text) for the terms of the vocabulary, each document with its length in all its terms."""
    words = docs.sparkSession.sparkContext.broadcast(vocabulary)  # of ITEM_BYTES of items at most
    table = byte_table(SEPARATORS, lower=True)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(words.value, pa.string())
        for rows in slices(batches, 1, SLICE, SLICE_ROWS):
            tokens, counts = split_tokens(rows.column(1), table)
            term = pc.index_in(tokens, value_set=known)
            hit = np.flatnonzero(term.is_valid().to_numpy(zero_copy_only=False))
            doc = np.repeat(np.arange(len(counts)), counts)[hit]
            pairs, tfs = np.unique(term.fill_null(0).to_numpy(zero_copy_only=False)[hit].astype(np.int64) * max(1, len(counts)) + doc, return_counts=True)
            terms, sizes = np.unique(pairs // max(1, len(counts)), return_counts=True)
            values = (int((counts > 0).sum()), int(counts.sum()), rows.column(0), counts, terms, sizes, pairs % max(1, len(counts)), tfs)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
            arrays = [pa.array([v], k) if isinstance(v, int) else pa.ListArray.from_arrays([0, len(v)], v.cast(k) if isinstance(v, pa.Array) else pa.array(v, k)) for v, k in zip(values, kinds)]
            yield pa.record_batch(arrays, names=[c.split()[0] for c in SEGMENT.split(", ")])

    return docs.mapInArrow(lambda batches: releasing(build(batches)), SEGMENT)


class Best:
    """The k best documents of an item so far: the highest score first, then the smallest id, nulls last."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.nulls = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def threshold(self) -> int:
        """Documents with a lower score can't be among the k best."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        scores, ids, nulls = (np.concatenate(x) for x in ((self.scores, scores), (self.ids, ids), (self.nulls, nulls)))
        order = np.lexsort((ids, nulls, -scores))[: self.k]
        self.scores, self.ids, self.nulls = scores[order], ids[order], nulls[order]


class Segment:
    """The inverted lists of one segment with each posting's impact, which is its score but for the term's weight."""

    def __init__(self, row, n_docs: int, n_terms: int, n_words: int):
        take = lambda name: row[name].values.to_numpy(zero_copy_only=False)
        ids = row["ids"].values
        self.nulls = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        lengths = take("lengths").astype(np.int64)
        if 25 * int(lengths.max(initial=0)) * n_docs >= 1 << 63:
            m = np.array([75 + 25 * int(n) * n_docs // n_terms for n in lengths], np.int64)
        else:
            m = 75 + 25 * lengths * n_docs // n_terms
        self.docs, tfs = take("places").astype(np.int64), take("tfs").astype(np.int64)
        self.impacts = 1_000_000_000 * tfs // (1000 * tfs + 12 * m[self.docs])
        terms, sizes = take("terms"), take("sizes").astype(np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.highest = np.maximum.reduceat(self.impacts, self.starts) if len(terms) else np.zeros(0, np.int64)
        self.at = np.full(n_words, -1, np.int64)
        self.at[terms] = np.arange(len(terms))
        self.sums = np.zeros(len(self.ids), np.int64)  # all zero between searches

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best) -> None:
        at = self.at[terms]
        at, weights = at[at >= 0], weights[at >= 0]
        bounds = weights * self.highest[at]
        least = best.threshold
        if bounds.sum() < least:
            return
        starts, ends = self.starts[at], self.ends[at]
        short = ends - starts <= SHORT * len(self.ids)
        sums = self.sums
        for s, e, w in zip(starts[short], ends[short], weights[short]):
            sums[self.docs[s:e]] += w * self.impacts[s:e]
        gathered = np.flatnonzero(sums)
        # iterators: (bound, documents, what each adds); the accumulators are one of them
        iterators = [(int(sums[gathered].max()), gathered, sums[gathered])] if len(gathered) else []
        sums[gathered] = 0
        for s, e, w, b in zip(starts[~short], ends[~short], weights[~short], bounds[~short]):
            iterators.append((int(b), self.docs[s:e], (w, self.impacts[s:e])))
        iterators.sort(key=lambda i: i[0])
        below, rest = 0, 0  # how many of the lowest bounds, added up, stay under the threshold
        while below < len(iterators) and rest + iterators[below][0] < least:
            rest += iterators[below][0]
            below += 1
        values = lambda adds, i=slice(None): adds[i] if isinstance(adds, np.ndarray) else adds[0] * adds[1][i]
        for _, docs, adds in iterators[below:]:
            sums[docs] += values(adds)
        found = np.flatnonzero(sums)
        scores = sums[found]
        sums[found] = 0
        for bound, docs, adds in reversed(iterators[:below]):
            chance = scores + rest >= least
            found, scores = found[chance], scores[chance]
            if not len(found):
                return
            place = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
            there = docs[place] == found
            scores[there] += values(adds, place[there])
            rest -= bound
        good = scores >= least
        if good.any():
            best.add(scores[good], self.ids[found[good]], self.nulls[found[good]])


def search_segments(segments: DataFrame, items: list[tuple[np.ndarray, np.ndarray]], n_docs: int, n_terms: int, n_words: int, k: int) -> DataFrame:
    """The k best documents of each task for each item, which is (terms, weights)."""
    asked = segments.sparkSession.sparkContext.broadcast(items)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in asked.value]
        for batch in batches:
            for row in range(batch.num_rows):
                segment = Segment({name: batch.column(name)[row] for name in batch.schema.names}, n_docs, n_terms, n_words)
                for (terms, weights), b in zip(asked.value, best):
                    segment.search(terms, weights, b)
        number = np.repeat(np.arange(len(best), dtype=np.int32), [len(b.scores) for b in best])
        joined = lambda name: np.concatenate([getattr(b, name) for b in best] or [np.zeros(0)])
        yield pa.record_batch([pa.array(number), pa.array(joined("ids").astype(np.int64), mask=joined("nulls").astype(bool)), pa.array(joined("scores").astype(np.int64))], names=["item_no", "doc_id", "score"])

    return segments.select("ids", "lengths", "terms", "sizes", "places", "tfs").mapInArrow(lambda batches: releasing(search(batches)), FOUND)


def _item_blocks(items: DataFrame) -> Iterator[list]:
    """Items in blocks of at most ITEM_BYTES of text, or one longer item."""
    block, size = [], 0
    for row in items.toLocalIterator():
        n = len(row[1] or "") * 4
        if block and size + n > ITEM_BYTES:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += n
    if block:
        yield block


def _ranked(spark: SparkSession, docs: DataFrame, block: list, schema: T.StructType, k: int) -> DataFrame | None:
    texts = [item_terms(text) for _, text in block]
    vocabulary = sorted({t for terms in texts for t in terms})
    if not vocabulary:
        return None
    number = {t: n for n, t in enumerate(vocabulary)}
    segments = store(build_segments(docs, vocabulary), "search-segments")
    n_docs, n_terms = segments.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    if not n_terms:
        return None
    lists = segments.select(F.explode(F.arrays_zip("terms", "sizes")).alias("l"))
    df = dict(lists.groupBy("l.terms").agg(F.sum("l.sizes")).collect())  # a row for each term of the block at most
    weight = {n: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for n, d in df.items()}
    asked = []
    for terms in texts:
        ids, repeats = np.unique(np.array([number[t] for t in terms if number[t] in weight], np.int64), return_counts=True)
        asked.append((ids, repeats * np.array([weight[i] for i in ids.tolist()], np.int64)))
    found = search_segments(segments, asked, n_docs, n_terms, len(vocabulary), k)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part, place = F.pmod(F.xxhash64("doc_id"), F.lit(SHARES)), F.row_number()
    found = found.withColumn("place", place.over(Window.partitionBy("item_no", part).orderBy(*order))).where(F.col("place") <= k)
    found = found.withColumn("rank", place.over(Window.partitionBy("item_no").orderBy(*order))).where(F.col("rank") <= k)
    names = spark.createDataFrame([(n, item) for n, (item, _) in enumerate(block)], T.StructType([T.StructField("item_no", T.IntegerType()), schema[0]]))
    return found.join(F.broadcast(names), "item_no").select(F.col(schema[0].name).alias("item_id"), "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents with a score above 0 of each item, or all if there are fewer.

    Terms are maximal runs of ASCII digits and letters and of other than ASCII characters, A-Z lower-cased. A term's weight is
    floor(1000 ln((2 N + 2) / (2 df + 1))), and it adds weight * (10^9 tf // (1000 tf + 12 m)) for each time the item has it,
    where m = 75 + 25 n N // L.
    Nulls: a null text has no terms, so it is never found and an item without text finds nothing; a null id is ranked after
    the others of its score. Ties: the smaller id first. Repeated rows: each row is a document, and each row of items an item
    of its own. Very long texts: whole; a text beyond SLICE is a segment of its own. Empty tables: empty result. Other
    columns aren't read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = items.select(F.col(item_id), F.col(item_text))
    parts = [p for block in _item_blocks(items) if (p := _ranked(spark, docs, block, items.schema, k)) is not None]
    if not parts:
        kind = items.schema[0].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, parts)
