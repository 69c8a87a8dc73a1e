"""Token ids in files of patched frame-of-reference blocks.

Ids are written in ascending order of the document ids. A file row is a segment of whole documents with at least
SEGMENT ids, if there are as many: a header, an index of the blocks' starts, the documents' ids and lengths, and blocks of
BLOCK ids. A block subtracts its minimum and packs the rest at the width that holds PERCENTILE per cent of it; ids that are
wider go to its exception list.

Segment, little-endian: b"PFR2", u64 ids before it in its part, u32 number of ids, u32 block size, u32 number of blocks,
u32 number of documents, u32 number of documents without an id (the last ones), u32 start of each block, i64 id and u32
length of each document, blocks; block: u32 minimum, u8 width, u16 number of exceptions, packed bits, u16 place of each
exception, u32 excess of each. The segments are rows of a Parquet table, whose commit protocol keeps them whole when tasks
are run again; beside the segment a row has only what orders it.
"""

from __future__ import annotations

import functools
import json
import os
import struct
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, store

BLOCK = 4096
SEGMENT = 65_536
PERCENTILE = 90
END_ID = 1
#: Words whose ids a worker remembers; beyond that it forgets all and starts again.
REMEMBERED = 600_000
#: Words that the tokenizer gets at a time.
TOGETHER = 4096
LAST_PLAIN = chr(0xFF)
#: A mark between a small letter and a space is a pre-token of its own, so that it may stand apart.
MARK = "([a-z\u00df-\u00f6\u00f8-\u00ff])([.,;:!?])( |$)"
#: Bytes of text that are encoded at a time; a longer text is encoded alone.
SLICE = 4 << 20

MAGIC = b"PFR2"
HEAD = struct.Struct("<4sQIIIII")
SEGMENTS = "part int, seq int, n_values long, payload binary"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# ---- blocks


def pack_block(values: np.ndarray) -> bytes:
    low = int(values.min())
    excess = (values - np.uint32(low)).astype("<u4")
    kth = max(0, -(-len(excess) * PERCENTILE // 100) - 1)
    width = int(np.partition(excess, kth)[kth]).bit_length()
    over = np.flatnonzero(excess >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
    body = excess.copy()
    body[over] = 0
    n_bytes = -(-width // 8)
    bits = np.unpackbits(body.view(np.uint8).reshape(-1, 4)[:, :n_bytes], axis=1, bitorder="little")[:, :width]
    packed = np.packbits(bits.ravel(), bitorder="little").tobytes()
    return struct.pack("<IBH", low, width, len(over)) + packed + over.astype("<u2").tobytes() + excess[over].tobytes()


def unpack_block(data: memoryview, n: int) -> np.ndarray:
    low, width, n_over = struct.unpack_from("<IBH", data)
    at = 7
    packed = np.frombuffer(data, np.uint8, -(-n * width // 8), at)
    at += len(packed)
    n_bytes = -(-width // 8)
    bits = np.zeros((n, 8 * n_bytes), np.uint8)
    bits[:, :width] = np.unpackbits(packed, count=n * width, bitorder="little").reshape(n, width)
    whole = np.zeros((n, 4), np.uint8)
    if width:
        whole[:, :n_bytes] = np.packbits(bits, axis=1, bitorder="little")
    out = whole.view("<u4").ravel().astype(np.uint32)
    if n_over:
        places = np.frombuffer(data, "<u2", n_over, at)
        out[places] = np.frombuffer(data, "<u4", n_over, at + 2 * n_over)
    return out + np.uint32(low)


def pack_segment(values: np.ndarray, block: int = BLOCK, ids: list[int | None] = (), lengths: np.ndarray = (), start: int = 0) -> bytes:
    blocks = [pack_block(values[i : i + block]) for i in range(0, len(values), block)]
    nameless = sum(i is None for i in ids)
    docs = np.array([i or 0 for i in ids], "<i8").tobytes() + np.asarray(lengths, "<u4").tobytes()
    head = HEAD.size + 4 * len(blocks) + len(docs)
    starts = np.cumsum([head, *map(len, blocks)])[:-1].astype("<u4")
    return HEAD.pack(MAGIC, start, len(values), block, len(blocks), len(ids), nameless) + starts.tobytes() + docs + b"".join(blocks)


def segment_documents(payload: bytes) -> tuple[int, list[int | None], np.ndarray]:
    """The ids before the segment in its part, and the ids and lengths of its documents."""
    _, start, _, _, n_blocks, n_docs, nameless = HEAD.unpack_from(payload)
    at = HEAD.size + 4 * n_blocks
    ids = np.frombuffer(payload, "<i8", n_docs, at).tolist()
    return start, ids[: n_docs - nameless] + [None] * nameless, np.frombuffer(payload, "<u4", n_docs, at + 8 * n_docs)


def unpack_segment(payload: bytes, first: int = 0, count: int | None = None) -> np.ndarray:
    """The ids from first on; by the index, only the blocks that have some of them are opened."""
    if payload[:4] != MAGIC:
        raise ValueError("not a segment")
    _, _, n, block, n_blocks, _, _ = HEAD.unpack_from(payload)
    last = n if count is None else min(n, first + count)
    if last <= first:
        return np.empty(0, np.uint32)
    starts = np.frombuffer(payload, "<u4", n_blocks, HEAD.size)
    view = memoryview(payload)
    b0, b1 = first // block, (last - 1) // block
    parts = [unpack_block(view[int(starts[b]) :], min(block, n - b * block)) for b in range(b0, b1 + 1)]
    return np.concatenate(parts)[first - b0 * block : last - b0 * block]


# ---- ids


class Encoder:
    """Ids of texts. The tokenizer deletes white space before it merges, so words between spaces and line ends are encoded by
    themselves, each once while it is remembered. New words are encoded many at a time: words of Latin letters with a space
    between them, since each ends with a token that has the tokenizer's mark of a word's end; all others parted by a special
    token, which the tokenizer takes out before anything else."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = [t for t in self.tokenizer.get_added_tokens_decoder().items() if t[1].special and not (t[1].lstrip or t[1].rstrip or t[1].single_word)]
        self.mark = special[0] if special else None
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.known = {"": 0}
        self.starts, self.lengths = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _encode_words(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The words in some order, their ids one after another, and how many each has."""
        plain, rest = [], []
        for w in words:
            (plain if w.isalpha() and (w.isascii() or max(w) <= LAST_PLAIN) else rest).append(w)
        order, values, lengths = [], [], []
        for at in range(0, len(plain), TOGETHER):
            part = plain[at : at + TOGETHER]
            ids = self._ids(" ".join(part))
            ends = np.flatnonzero(self.ends[ids])
            if len(ends) != len(part):
                rest += part
                continue
            order += part
            values.append(ids)
            lengths.append(np.diff(ends, prepend=-1))
        single = rest
        if self.mark:
            single = [w for w in rest if "<" in w]
            joined = [w for w in rest if "<" not in w]
            for at in range(0, len(joined), TOGETHER):
                part = joined[at : at + TOGETHER]
                ids = self._ids(self.mark[1].content.join(part))
                at_mark = ids == self.mark[0]
                order += part
                values.append(ids[~at_mark])
                lengths.append(np.diff(np.append(np.flatnonzero(at_mark), len(ids)), prepend=-1) - 1)
        for w in single:
            order.append(w)
            values.append(self._ids(w))
            lengths.append(np.array([len(values[-1])]))
        return order, np.concatenate(values), np.concatenate(lengths)

    def _learn(self, words: list[str]) -> None:
        order, values, lengths = self._encode_words(words)
        if self.used + len(values) > len(self.flat):
            self.flat = np.concatenate((self.flat[: self.used], np.empty(max(self.used, len(values)) + len(values), np.uint32)))
        self.flat[self.used : self.used + len(values)] = values
        first = len(self.starts)
        self.starts = np.concatenate((self.starts, self.used + np.cumsum(lengths) - lengths))
        self.lengths = np.concatenate((self.lengths, lengths))
        self.used += len(values)
        self.known.update(zip(order, range(first, first + len(order))))

    def encode_many(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has."""
        ready = pa.array([lowered(t or "").replace("\n", " ") for t in texts], pa.large_string())
        words = pc.split_pattern(pc.replace_substring_regex(ready, MARK, r"\1 \2\3"), " ")
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(found < 0)
        if len(new) and len(self.known) + len(new) > REMEMBERED:
            self._forget()
            found[:] = 0
            new = np.flatnonzero([bool(w) for w in distinct])
        if len(new):
            own = [distinct[i] for i in new.tolist()]
            self._learn(own)
            found[new] = list(map(self.known.__getitem__, own))
        slots = found[coded.indices.to_numpy()]
        n = self.lengths[slots]
        ends = np.cumsum(n)
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[slots] - (ends - n), n)
        bounds = np.concatenate((np.zeros(1, np.int64), ends))[words.offsets.to_numpy()]
        return self.flat[places], np.diff(bounds)


def lowered(text: str) -> str:
    """Lower case, as the tokenizer makes it first of all, where that can't differ from its own: in Latin-1 without the strings of
    special tokens, which it takes out before. Fewer chunks are new then."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text if "<|" in text else text.lower()


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_ids(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, append END_ID to each document and write the segments; the result reads the written table.

    A null text counts as empty: END_ID alone. Null ids come last; rows that share an id follow one another, by a hash of
    their text. A document is never cut, however long. Empty table: no segments. Extra columns are left out.
    """
    path = path or default_path()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path).encode_many, TaskContext.get().partitionId()
        ids, values, lengths = [], np.empty(0, np.uint32), np.empty(0, np.int64)
        seq = start = 0

        def close(n_docs: int, n_values: int) -> pa.RecordBatch:
            nonlocal ids, lengths, values, seq, start
            row = [[part], [seq], [n_values], [pack_segment(values[:n_values], BLOCK, ids[:n_docs], lengths[:n_docs], start)]]
            seq, start, ids, lengths, values = seq + 1, start + n_values, ids[n_docs:], lengths[n_docs:], values[n_values:]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["part", "seq", "n_values", "payload"])

        for rows in slices(batches, 1, SLICE):
            own, n = encode(rows.column(1).to_pylist())
            values = np.concatenate((values, np.insert(own, np.cumsum(n), END_ID)))
            lengths = np.concatenate((lengths, n + 1))
            ids += rows.column(0).to_pylist()
            while len(values) >= SEGMENT:
                ends = np.cumsum(lengths)
                last = int(np.searchsorted(ends, SEGMENT))
                yield close(last + 1, int(ends[last]))
        if ids:
            yield close(len(ids), len(values))

    keys = [F.asc_nulls_last("doc_id"), F.xxhash64("text")]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return store(rows.mapInArrow(segments, SEGMENTS), "pfor", compression="uncompressed")


def read_ids(segments: DataFrame) -> DataFrame:
    """One row per document from the written segments: doc_id, start, n_tokens, ids_crc32."""
    part_sizes = sorted(tuple(r) for r in segments.groupBy("part").agg(F.sum("n_values")).collect())  # one row for each partition
    starts, total = [], 0
    for part, n in part_sizes:
        starts.append((part, total))
        total += n
    offsets = segments.sparkSession.createDataFrame(starts, "part int, part_start long")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part_start, payload in zip(*(c.to_pylist() for c in batch.columns)):
                before, ids, lengths = segment_documents(payload)
                raw = memoryview(unpack_segment(payload).astype("<u4").tobytes())
                ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(lengths, dtype=np.int64)))
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                columns = (ids, ends[:-1] + (part_start + before), lengths, crcs)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = segments.join(F.broadcast(offsets), "part").select("part_start", "payload")
    return placed.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")
