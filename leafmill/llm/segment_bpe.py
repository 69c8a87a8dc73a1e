"""Byte-level BPE encoding and decoding with a segment tree.

Each pre-token is a row of byte symbols. A segment tree over the adjacent pairs keeps the lowest merge rank of every span:
the root has the lowest rank, the way down by the left child first ends at its leftmost place, and a merge changes three
leaves, each in logarithmic time. The loop ends when the root has no rank. The vocabulary is a file of the tokenizers
library whose place is a parameter; every worker reads it there once.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import join_known, releasing, remember

#: Pieces of text and pre-tokens whose ids a task remembers; beyond that it forgets the later ones.
REMEMBERED = 100_000
#: Words of up to so many pairs are merged together with others of their size; longer ones one by one.
WIDEST = 64
#: Rows that are worked on at a time.
SLICE = 250

# Fixed value: the pre-token pattern of byte-level vocabularies. White space is spelt out, as libraries differ on U+001C-1F.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

NO_RANK, NONE = 1 << 40, (1 << 31) - 1
MARKS = frozenset(".,;:!?")
SPACE_BESIDE_SPACE = re.compile(r"\s\s")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself if printable, else from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def merge_pairs(symbols: list[int], ranks: dict[int, int], made: list[int], shift: int) -> list[int]:
    """Merge the leftmost pair of the lowest rank until none has a rank. ranks: by left << shift | right; made: by rank."""
    n = len(symbols)
    if n < 2:
        return symbols
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [NO_RANK] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        tree[size + i] = get(symbols[i] << shift | symbols[i + 1], NO_RANK)
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    while (best := tree[1]) != NO_RANK:
        i = 1
        while i < size:
            i *= 2
            if tree[i] != best:
                i += 1
        at = i - size
        gone = after[at]
        symbols[at] = made[best]
        nxt = after[gone]
        after[at] = nxt
        symbols[gone] = -1
        changed = [(gone, NO_RANK)]
        if nxt < n:
            before[nxt] = at
            changed.append((at, get(symbols[at] << shift | symbols[nxt], NO_RANK)))
        else:
            changed.append((at, NO_RANK))
        if (prev := before[at]) >= 0:
            changed.append((prev, get(symbols[prev] << shift | symbols[at], NO_RANK)))
        for leaf, rank in changed:
            i = size + leaf
            if i >= 2 * size:  # the last symbol starts no pair
                continue
            tree[i] = rank
            i >>= 1
            while i:
                a, b = tree[2 * i], tree[2 * i + 1]
                low = a if a < b else b
                if tree[i] == low:
                    break
                tree[i] = low
                i >>= 1
    return [s for s in symbols if s >= 0]


class SegmentBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        letters = byte_letters()
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.shift = size.bit_length()
        self.ranks, self.made = {}, []
        for rank, (a, b) in enumerate(pairs):
            self.ranks.setdefault(vocab[a] << self.shift | vocab[b], rank)
            self.made.append(vocab[a + b])
        self.bytes = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        first = [0] * 256
        for letter, b in letters.items():
            first[b] = vocab[letter]
        self.first = np.array(first, np.int32)
        keys = np.fromiter(self.ranks, np.int64, len(self.ranks))
        order = np.argsort(keys)
        self.keys, self.key_ranks = keys[order], np.fromiter(self.ranks.values(), np.int32, len(keys))[order]
        self.made_array = np.array(self.made, np.int32)
        self.pattern = regex.compile(PATTERN)
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.known: dict[str, bytes] = {}  # pieces and pre-tokens

    # ---- merging many words at once: a row of symbols and a row of a tree for each

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << self.shift | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_ranks[at], NONE)

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian 32-bit numbers."""
        out: list[bytes] = [b""] * len(words)
        sizes = [1 << max(0, len(w) - 2).bit_length() if len(w) > 1 else 1 for w in words]
        for size in set(sizes):
            own = [i for i, s in enumerate(sizes) if s == size]
            if size > WIDEST:
                for i in own:
                    out[i] = np.array(merge_pairs(self.first[np.frombuffer(words[i], np.uint8)].tolist(), self.ranks, self.made, self.shift), "<i4").tobytes()
                continue
            for at in range(0, len(own), 4096):
                part = own[at : at + 4096]
                for i, ids in zip(part, self._merge_rows([words[i] for i in part], size)):
                    out[i] = ids
        return out

    def _merge_rows(self, words: list[bytes], size: int) -> list[bytes]:
        n = np.array([len(w) for w in words])
        rows = np.repeat(np.arange(len(words)), n)
        columns = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        symbol = np.full((len(words), size + 2), -1, np.int32)
        symbol[rows, columns] = self.first[np.frombuffer(b"".join(words), np.uint8)]
        after = np.broadcast_to(np.arange(1, size + 3, dtype=np.int32), symbol.shape).copy()
        before = after - 2
        tree = np.full((len(words), 2 * size), NONE, np.int32)
        pair_rows, pair_columns = np.nonzero((symbol[:, :size] >= 0) & (symbol[:, 1 : size + 1] >= 0))
        tree[pair_rows, size + pair_columns] = self._rank(symbol[pair_rows, pair_columns], symbol[pair_rows, pair_columns + 1])
        level = size
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])

        def update(r: np.ndarray, leaf: np.ndarray, rank: np.ndarray | int) -> None:
            i = size + leaf
            tree[r, i] = rank
            while i[0] > 1 if len(i) else False:
                i = i >> 1
                tree[r, i] = np.minimum(tree[r, 2 * i], tree[r, 2 * i + 1])

        r = np.flatnonzero(tree[:, 1] < NONE)
        while len(r):
            best = tree[r, 1]
            i = np.ones(len(r), np.int64)
            for _ in range(size.bit_length() - 1):  # down to the leftmost leaf that has the root's rank
                i = 2 * i + (tree[r, 2 * i] != best)
            at = i - size
            gone = after[r, at]
            nxt = after[r, gone]
            symbol[r, at] = self.made_array[best]
            symbol[r, gone] = -1
            after[r, at] = nxt
            has_leaf = gone < size
            update(r[has_leaf], gone[has_leaf], NONE)
            has_next = nxt < n[r]
            before[r[has_next], nxt[has_next]] = at[has_next]
            rank = np.full(len(r), NONE, np.int32)
            rank[has_next] = self._rank(symbol[r[has_next], at[has_next]], symbol[r[has_next], nxt[has_next]])
            update(r, at, rank)
            prev = before[r, at]
            has_prev = prev >= 0
            rp, pp = r[has_prev], prev[has_prev]
            update(rp, pp, self._rank(symbol[rp, pp], symbol[rp, at[has_prev]]))
            r = r[tree[r, 1] < NONE]
        kept = symbol >= 0
        ids = symbol[kept].astype("<i4").tobytes()
        ends = (4 * np.cumsum(kept.sum(axis=1))).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    # ---- texts

    def _pieces(self, text: str) -> list[str]:
        """Pieces of an ordinary text that are encoded each by itself: chunks with the one space before them where all white
        space stands alone between other characters, which no pre-token crosses; else the pre-tokens."""
        if not text or text[0].isspace() or text[-1].isspace() or "\0" in text or SPACE_BESIDE_SPACE.search(text):
            return self.pattern.findall(text)
        return text.replace(" ", "\0 ").split("\0")

    def _words(self, piece: str) -> list[str]:
        """The pre-tokens of a piece; letters after a space, and a mark after them, need no pattern."""
        bare = piece[1:] if piece[:1] == " " else piece
        if bare.isalpha():
            return [piece]
        if bare[-1:] in MARKS and bare[:-1].isalpha():
            return [piece[:-1], piece[-1]]
        return self.pattern.findall(piece)

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        parts = list(map(self._words, new))
        # a piece that is one pre-token and that pre-token are the same string, so they are remembered together
        known = self.known
        fresh = list({w for ws in parts for w in ws if w not in known})
        ids = dict(zip(fresh, self.merge_words([w.encode() for w in fresh])))
        get = lambda w: ids[w] if w in ids else known[w]
        found = {piece: get(ws[0]) if len(ws) == 1 else b"".join([get(w) for w in ws]) for piece, ws in zip(new, parts)}
        remember(known, ids | found, REMEMBERED)
        return found

    def forget(self) -> None:
        """Workers outlive tasks; what a task remembered would stand beside the next stages' memory."""
        self.known = {}

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers; the strings of special tokens become their ids."""
        pieces: list[list[str]] = []
        plan: list[list[int | bytes]] = []  # of each text, places in pieces and ids of special tokens

        def ordinary(text: str) -> int:
            pieces.append(self._pieces(text))
            return len(pieces) - 1

        for text in texts:
            if self.split is None or not any(s in text for s in self.special):
                plan.append([ordinary(text)])
                continue
            parts, at = [], 0
            for m in self.split.finditer(text):
                parts += [ordinary(text[at : m.start()]), self.special[m[0]].to_bytes(4, "little")]
                at = m.end()
            plan.append([*parts, ordinary(text[at:])])
        done = join_known(pieces, self.known, self._learn)
        return [b"".join([p if isinstance(p, bytes) else done[p] for p in parts]) for parts in plan]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_many([text])[0], "<i4").tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", errors="replace")


@functools.lru_cache(maxsize=4)
def load(path: str) -> SegmentBpe:
    return SegmentBpe(path)


def _encoding(batches: Iterator[pa.RecordBatch], path: str, text_col: str, ids_col: str) -> Iterator[pa.RecordBatch]:
    bpe = load(path)
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            found = bpe.encode_many([t or "" for t in part.column(part.schema.get_field_index(text_col)).to_pylist()])
            offsets = np.cumsum([0, *(len(f) // 4 for f in found)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), "<i4")))
            yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*part.schema.names, ids_col])
    bpe.forget()


def _decoding(batches: Iterator[pa.RecordBatch], path: str, ids_col: str, text_col: str) -> Iterator[pa.RecordBatch]:
    bpe = load(path)
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            ids = part.column(part.schema.get_field_index(ids_col))
            ends = np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
            flat = ids.flatten().to_numpy(zero_copy_only=False).tolist()
            texts = pa.array([bpe.decode(flat[a:b]) for a, b in zip([0, *ends], ends)], pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*part.schema.names, text_col])


def _with(df: DataFrame, *fields: T.StructField) -> T.StructType:
    return T.StructType([*df.schema.fields, *fields])


IDS, TEXT = T.ArrayType(T.IntegerType(), False), T.StringType()


def bpe_encode(docs: DataFrame, path: str | None = None, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with the array column ids_col.

    A null text counts as empty and has no ids; texts are encoded whole; repeated rows each. Extra columns stay; one named
    ids_col is replaced. Empty table: empty result.
    """
    path = path or default_path()
    docs = docs.drop(ids_col)
    return docs.mapInArrow(lambda batches: releasing(_encoding(batches, path, text_col, ids_col)), _with(docs, T.StructField(ids_col, IDS)))


def bpe_decode(encoded: DataFrame, path: str | None = None, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """encoded with the string column text_col; null ids give an empty text, bytes that aren't UTF-8 U+FFFD."""
    path = path or default_path()
    encoded = encoded.drop(text_col)
    return encoded.mapInArrow(lambda batches: releasing(_decoding(batches, path, ids_col, text_col)), _with(encoded, T.StructField(text_col, TEXT)))


def bpe_both(docs: DataFrame, path: str | None = None, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """docs with ids_col and what these ids decode to, in one worker for a task instead of two."""
    path = path or default_path()
    docs = docs.drop(ids_col, decoded_col)
    schema = _with(docs, T.StructField(ids_col, IDS), T.StructField(decoded_col, TEXT))
    return docs.mapInArrow(lambda batches: releasing(_decoding(_encoding(batches, path, text_col, ids_col), path, ids_col, decoded_col)), schema)
