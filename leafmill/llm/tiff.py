"""Media columns: TIFF.

decode_pages() walks the image directories of each file in a binary column and emits one row per page: strips and tiles,
stored plain or as PackBits, LZW or deflate, predictors undone. encode_media() stores texts as greyscale pages.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# TIFF 6.0 tags, field sizes and compression schemes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, CHANNELS, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
FILL_ORDER = 266
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 284, 317, 322, 323, 324, 325, 339
FIELD_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773

#: Stored texts: bytes in a row of samples, rows in a page and in a strip.
ROW, PAGE_ROWS, STRIP_ROWS = 576, 2048, 256
#: Bytes of a decoded page; a page that declares more gives an error row, and nothing is allocated or inflated for it.
MOST_BYTES = 1 << 28


# ---- codecs


def unpack_bits(data: bytes, most: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < most:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        run = 1
        while run < 128 and i + run < len(data) and data[i + run] == data[i]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        j = i + 1
        while j < len(data) and j - i < 128 and (j + 1 >= len(data) or data[j] != data[j + 1]):
            j += 1
        out += bytes((j - i - 1,)) + data[i:j]
        i = j
    return bytes(out)


def unpack_lzw(data: bytes, most: int) -> bytes:
    """Codes of 9 to 12 bits, most significant first; the width grows one code early."""
    base = [bytes((i,)) for i in range(256)] + [b"", b""]
    words, out, width, acc, n_bits, last = list(base), bytearray(), 9, 0, 0, b""
    for byte in data:
        acc, n_bits = (acc << 8 | byte) & 0xFFFFFF, n_bits + 8
        if n_bits < width:
            continue
        n_bits -= width
        code = acc >> n_bits & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            words, width, last = list(base), 9, b""
            continue
        if code < len(words):
            word = words[code]
        elif last:
            word = last + last[:1]
        else:
            raise ValueError("bad LZW code")
        out += word
        if len(out) >= most:
            break
        if last:
            words.append(last + word[:1])
        last = word
        width = 9 if len(words) < 511 else 10 if len(words) < 1023 else 11 if len(words) < 2047 else 12
    return bytes(out)


def pack_lzw(data: bytes) -> bytes:
    out, acc, n_bits, width = bytearray(), 0, 0, 9
    words = {bytes((i,)): i for i in range(256)}
    following = 258

    def put(code: int) -> None:
        nonlocal acc, n_bits
        acc, n_bits = acc << width | code, n_bits + width
        while n_bits >= 8:
            n_bits -= 8
            out.append(acc >> n_bits & 255)
        acc &= (1 << n_bits) - 1

    put(256)
    word = b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in words:
            word = longer
            continue
        put(words[word])
        words[longer] = following
        following += 1
        width = 9 if following < 512 else 10 if following < 1024 else 11 if following < 2048 else 12
        if following >= 4094:
            put(256)
            words, following, width = {bytes((k,)): k for k in range(256)}, 258, 9
        word = data[i : i + 1]
    if word:
        put(words[word])
        following += 1
        width = 9 if following < 512 else 10 if following < 1024 else 11 if following < 2048 else 12
    put(257)
    if n_bits:
        out.append(acc << (8 - n_bits) & 255)
    return bytes(out)


def inflate(data: bytes, most: int) -> bytes:
    return zlib.decompressobj().decompress(data, most)


#: From stored bytes and the most that are wanted.
UNPACK = {PLAIN: lambda data, most: data[:most], LZW: unpack_lzw, DEFLATE: inflate, OLD_DEFLATE: inflate, PACKBITS: unpack_bits}
PACK = {PLAIN: bytes, LZW: pack_lzw, DEFLATE: lambda b: zlib.compress(b, 3), PACKBITS: pack_bits}


# ---- reading


@dataclass
class Page:
    page: int
    width: int | None = None
    height: int | None = None
    channels: int | None = None
    bits: int | None = None
    compression: int | None = None
    samples: bytes | None = None  # rows from the top, channels of a pixel together, a byte for less than 8 bits, else little-endian
    error: str | None = None


def directories(data: bytes) -> Iterator[tuple[str, dict[int, list]]]:
    """Byte order and fields of each directory; a directory is walked once.

    Directories and arrays of values may not take more bytes together than the file has, as they would if they overlapped.
    """
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen, room = struct.unpack_from(order + "I", data, 4)[0], set(), len(data)
    while at and at not in seen:
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        room -= 6 + 12 * n
        fields = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            letter = {1: "B", 3: "H", 4: "I"}.get(kind)
            if letter is None:
                continue
            place = at + 10 + 12 * i
            if count * FIELD_SIZE[kind] > 4:
                (place,) = struct.unpack_from(order + "I", data, place)
                room -= count * FIELD_SIZE[kind]
            if room < 0:
                raise ValueError("directories overlap")
            fields[tag] = list(struct.unpack_from(f"{order}{count}{letter}", data, place))
        yield order, fields
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def undo_predictor(block: np.ndarray, predictor: int) -> np.ndarray:
    """block: rows x columns x channels."""
    if predictor == 1:
        return block
    if predictor == 2:
        return np.cumsum(block, axis=1, dtype=block.dtype)
    raise ValueError(f"predictor {predictor}")


def samples_of(raw: bytes, order: str, rows: int, width: int, deep: int, bits: int, predictor: int) -> np.ndarray:
    """The strip's or tile's samples, rows x columns x channels."""
    if bits < 8:
        if predictor != 1:
            raise ValueError(f"predictor {predictor} of {bits} bits")
        each = 8 // bits
        packed = np.frombuffer(raw, np.uint8).reshape(rows, -1)
        shifts = np.arange(8 - bits, -1, -bits, dtype=np.uint8)
        values = (packed[:, :, None] >> shifts & ((1 << bits) - 1)).reshape(rows, packed.shape[1] * each)
        return values[:, : width * deep].reshape(rows, width, deep)
    n = bits // 8
    if predictor == 3:  # bytes of equal weight together, the highest first, and differences between bytes
        planes = np.cumsum(np.frombuffer(raw, np.uint8).reshape(rows, -1, deep), axis=1, dtype=np.uint8).reshape(rows, n, width * deep)
        values = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">u{n}")
        return values.reshape(rows, width, deep).astype(f"<u{n}")
    return undo_predictor(np.frombuffer(raw, f"{order}u{n}").reshape(rows, width, deep).astype(f"<u{n}"), predictor)


def decode_page(number: int, data: bytes, order: str, tags: dict[int, list]) -> Page:
    one = lambda tag, default: tags.get(tag, [default])[0]
    width, height, channels, bits = tags[WIDTH][0], tags[HEIGHT][0], one(CHANNELS, 1), one(BITS, 1)
    scheme, predictor, planar = one(COMPRESSION, PLAIN), one(PREDICTOR, 1), one(PLANAR, 1)
    if bits not in (1, 2, 4, 8, 16, 32) or len(set(tags.get(BITS, [bits]))) > 1 or scheme not in UNPACK or (bits < 8 and one(FILL_ORDER, 1) != 1):
        raise ValueError(f"{bits} bits, compression {scheme}")
    tiled = TILE_OFFSETS in tags
    w, h = (tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]) if tiled else (width, min(height, one(ROWS_PER_STRIP, height)))
    offsets, lengths = (tags[TILE_OFFSETS], tags[TILE_BYTES]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_BYTES])
    sample = max(1, bits // 8)
    if min(width, height, channels, w, h) < 1 or max(width * height, w * h) * channels * sample > MOST_BYTES:
        raise ValueError(f"{width} x {height} x {channels} samples")
    across, down = -(-width // w), -(-height // h)
    planes, deep = (channels, 1) if planar == 2 else (1, channels)
    if min(len(offsets), len(lengths)) < planes * across * down:
        raise ValueError("strips are missing")
    image = np.zeros((height, width, channels), f"<u{sample}")
    for k in range(planes * across * down):
        plane, rest = divmod(k, across * down)
        y, x = rest // across * h, rest % across * w
        rows = h if tiled else min(h, height - y)
        size = rows * -(-w * deep * bits // 8)
        raw = UNPACK[scheme](data[offsets[k] : offsets[k] + lengths[k]], size)
        if len(raw) < size:
            raise ValueError(f"{len(raw)} of {size} bytes")
        block = samples_of(raw[:size], order, rows, w, deep, bits, predictor)[: height - y, : width - x]
        image[y : y + block.shape[0], x : x + block.shape[1], plane : plane + deep] = block
    return Page(number, width, height, channels, bits, scheme, image.tobytes())


def pages(data: bytes) -> Iterator[Page]:
    """Each page; for one that can't be decoded its error. An unreadable directory is an error too, and ends the file."""
    number, walk = 0, directories(data)
    while True:
        try:
            found = next(walk, None)
        except Exception as e:  # whatever a broken file leads to
            yield Page(number, error=f"{type(e).__name__}: {e}")
            return
        if found is None:
            return
        try:
            yield decode_page(number, data, *found)
        except Exception as e:
            yield Page(number, error=f"{type(e).__name__}: {e}")
        number += 1


# ---- writing


def tiff(images: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, strip_rows: int = STRIP_ROWS) -> bytes:
    """A little-endian file with a greyscale page of 8-bit samples for each array (rows x columns)."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for image in images:
        height, width = image.shape
        offsets, lengths = [], []
        for y in range(0, height, strip_rows):
            strip = image[y : y + strip_rows]
            if predictor == 2:
                strip = np.diff(strip, axis=1, prepend=np.zeros((len(strip), 1), np.uint8))
            packed = PACK[compression](np.ascontiguousarray(strip).tobytes())
            offsets.append(len(out))
            lengths.append(len(packed))
            out += packed
        arrays = []
        for values in (offsets, lengths):
            if len(values) == 1:
                arrays.append(values[0])
            else:
                out += b"\0" * (len(out) % 2)
                arrays.append(len(out))
                out += struct.pack(f"<{len(values)}I", *values)
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        n = len(offsets)
        fields = [(WIDTH, 4, 1, width), (HEIGHT, 4, 1, height), (BITS, 3, 1, 8), (COMPRESSION, 3, 1, compression), (PHOTOMETRIC, 3, 1, 1), (STRIP_OFFSETS, 4, n, arrays[0]), (CHANNELS, 3, 1, 1), (ROWS_PER_STRIP, 4, 1, strip_rows), (STRIP_BYTES, 4, n, arrays[1]), (PREDICTOR, 3, 1, predictor)]
        out += struct.pack("<H", len(fields)) + b"".join(struct.pack("<HHII", *f) for f in fields)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def text_payload(text: str | None) -> tuple[int, bytes]:
    """The text in UTF-8 and, with bytes 255 appended up to a positive multiple of ROW, as it is stored."""
    raw = (text or "").encode()
    return len(raw), raw + b"\xff" * (max(ROW, -(-len(raw) // ROW) * ROW) - len(raw))


# ---- columns


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each whole text as a TIFF file. A null text counts as empty; empty table, empty result; rows
    that repeat are stored each; extra columns are left out. A text has as many pages as its length asks for."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sizes, media = [], []
                for text in part.column(1).to_pylist():
                    n, payload = text_payload(text)
                    image = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
                    sizes.append(n)
                    media.append(tiff([image[y : y + PAGE_ROWS] for y in range(0, len(image), PAGE_ROWS)]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"]
    return rows.mapInArrow(encode, T.StructType([kind, T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]))


PAGE_FIELDS = [
    T.StructField("page", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("channels", T.IntegerType()),
    T.StructField("bits", T.IntegerType()), T.StructField("compression", T.IntegerType()), T.StructField("samples", T.BinaryType()), T.StructField("error", T.StringType()),
]


def decode_pages(files: DataFrame, media_col: str = "media") -> DataFrame:
    """One row per page: the columns of files but media_col, then page, width, height, channels, bits, compression,
    samples, error.

    A page that can't be decoded gives a row with error and without samples, and the walk goes on; a file that isn't one,
    or null, gives one such row. The pages of a file follow one another in the result's partitions. Columns of files that
    have the name of a page column are replaced.
    """
    names = {f.name for f in PAGE_FIELDS}
    files = files.drop(*[c for c in files.columns if c in names])
    carried = [f for f in files.schema.fields if f.name != media_col]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32()] * 6 + [pa.binary(), pa.string()]
        for batch in batches:
            own = [batch.column(batch.schema.get_field_index(f.name)) for f in carried]
            for i, data in enumerate(batch.column(batch.schema.get_field_index(media_col)).to_pylist()):
                rows = [(p.page, p.width, p.height, p.channels, p.bits, p.compression, p.samples, p.error) for p in pages(data or b"")]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                ids = [c.take(pa.array([i] * len(rows))) for c in own]
                if rows:
                    yield pa.RecordBatch.from_arrays([*ids, *columns], names=[*(f.name for f in carried), *(f.name for f in PAGE_FIELDS)])

    return files.mapInArrow(decode, T.StructType([*carried, *PAGE_FIELDS]))


def text_features(page_rows: DataFrame) -> DataFrame:
    """One row per stored text from the page rows of decode_pages(): payload_bytes, payload_sha256, tail_crc32, feature, error.
    With an error of one of its pages the others are null.

    The pages of a file follow one another in their partition, page 0 first, so a running digest does without a shuffle.
    """
    import hashlib

    own = [f for f in page_rows.schema.fields if f.name not in {p.name for p in PAGE_FIELDS}]
    out = [T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("feature", T.StringType()), T.StructField("error", T.StringType())]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, digest, n_bytes, n_pages, counts, tail, failed = None, hashlib.sha256(), 0, 0, np.zeros(16, np.int64), b"", None
        ready: list[tuple] = []

        def close() -> None:
            if failed is not None:
                ready.append((*head, None, None, None, None, failed))
                return
            hist = ",".join(map(str, counts.tolist()))
            ready.append((*head, n_bytes, digest.hexdigest(), zlib.crc32(tail), f"pages={n_pages};rows={n_bytes // ROW};hist16={hist}", None))

        def flush(batch_schema: pa.Schema) -> pa.RecordBatch:
            kinds = [*(batch_schema.field(f.name).type for f in own), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*ready), kinds)], names=[f.name for f in (*own, *out)])
            ready.clear()
            return made

        schema = None
        for batch in batches:
            schema = batch.schema
            columns = {f: batch.column(batch.schema.get_field_index(f)).to_pylist() for f in (*(f.name for f in own), "page", "samples", "error")}
            for i, (page, samples, error) in enumerate(zip(columns["page"], columns["samples"], columns["error"])):
                if page == 0:
                    if head is not None:
                        close()
                    head = tuple(columns[f.name][i] for f in own)
                    digest, n_bytes, n_pages, counts, tail, failed = hashlib.sha256(), 0, 0, np.zeros(16, np.int64), b"", None
                failed = failed if error is None else error
                samples = samples or b""
                digest.update(samples)
                n_bytes += len(samples)
                n_pages += 1
                counts = counts + np.bincount(np.frombuffer(samples, np.uint8) >> 4, minlength=16)
                tail = (tail + samples[-32:])[-32:]
            if len(ready) >= 2000:
                yield flush(schema)
        if head is not None:
            close()
        if ready:
            yield flush(schema)

    return page_rows.mapInArrow(features, T.StructType([*own, *out]))
