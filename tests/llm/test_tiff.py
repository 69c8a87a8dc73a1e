from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.llm import tiff as X


@given(st.binary(max_size=3000))
@settings(max_examples=80, deadline=None)
def test_codecs(data):
    assert X.unpack_bits(X.pack_bits(data), len(data)) == data
    assert X.unpack_lzw(X.pack_lzw(data), len(data)) == data


def test_lzw_grows_and_clears():
    data = np.random.default_rng(1).integers(0, 7, 200_000).astype(np.uint8).tobytes()
    assert X.unpack_lzw(X.pack_lzw(data), len(data)) == data
    # the example of the format's specification
    assert X.unpack_lzw(bytes([0x80, 0x01, 0xE0, 0x40, 0x80, 0x44, 0x08, 0x0C, 0x06, 0x80, 0x80]), 99)[:2] == b"\x07\x07"


@pytest.mark.parametrize("scheme", [X.PLAIN, X.LZW, X.DEFLATE, X.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
def test_files(scheme, predictor):
    images = [np.random.default_rng(3).integers(0, 256, (h, 48)).astype(np.uint8) for h in (1, 70)]
    pages = list(X.pages(X.tiff(images, scheme, predictor, strip_rows=16)))
    assert [p.samples for p in pages] == [i.tobytes() for i in images] and [(p.width, p.height, p.compression) for p in pages] == [(48, 1, scheme), (48, 70, scheme)]


def tiled(order):
    """A page of 20 x 18 pixels of three 16-bit channels in tiles of 16 x 16, with a predictor."""
    image = np.arange(18 * 20 * 3, dtype=np.uint16).reshape(18, 20, 3) * 37
    out, offsets, lengths = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0)), [], []
    for y in (0, 16):
        for x in (0, 16):
            tile = np.zeros((16, 16, 3), np.uint16)
            part = image[y : y + 16, x : x + 16]
            tile[: part.shape[0], : part.shape[1]] = part
            step = np.diff(tile, axis=1, prepend=np.zeros((16, 1, 3), np.uint16))
            packed = zlib.compress(step.astype(order + "u2").tobytes())
            offsets.append(len(out))
            lengths.append(len(packed))
            out += packed
    def array(letter, values):
        out.extend(b"\0" * (len(out) % 2))
        at = len(out)
        out.extend(struct.pack(f"{order}{len(values)}{letter}", *values))
        return at

    bits, where, sizes = array("H", [16] * 3), array("I", offsets), array("I", lengths)
    out += b"\0" * (len(out) % 2)
    struct.pack_into(order + "I", out, 4, len(out))
    fields = [(256, 4, 1, 20), (257, 4, 1, 18), (258, 3, 3, bits), (259, 3, 1, 8), (277, 3, 1, 3), (317, 3, 1, 2), (322, 4, 1, 16), (323, 4, 1, 16), (324, 4, 4, where), (325, 4, 4, sizes)]
    out += struct.pack(order + "H", len(fields))
    for tag, kind, count, value in fields:
        out += struct.pack(order + "HHI", tag, kind, count) + (struct.pack(order + "HH", value, 0) if kind == 3 and count == 1 else struct.pack(order + "I", value))
    return bytes(out + b"\0\0\0\0"), image


@pytest.mark.parametrize("order", ["<", ">"])
def test_tiles(order):
    data, image = tiled(order)
    (page,) = X.pages(data)
    assert page.samples == image.astype("<u2").tobytes() and (page.channels, page.bits) == (3, 16)


def test_texts(docs):
    rows = [(1, "é" * 10), (2, None), (3, ""), (4, "q" * (X.ROW * X.PAGE_ROWS + 5)), (4, "again"), (None, "n"), (6, "x" * 576)]
    media = X.encode_media(docs(rows, more=("media", "page", "samples")))
    pages = X.decode_pages(media)
    assert pages.where("doc_id = 4 and n_bytes > 100").count() == 2
    got = sorted((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in X.text_features(pages).collect())
    want = []
    for _, t in rows:
        n, payload = X.text_payload(t)
        want.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    assert got == sorted(want)
    assert X.text_features(X.decode_pages(X.encode_media(docs([])))).count() == 0


def test_broken_files(spark):
    good = X.tiff([np.zeros((2, 8), np.uint8)])
    rows = [(1, good, "a"), (2, None, "b"), (3, b"", "c"), (4, b"II*\0", "d"), (5, good[:20], "e"), (6, good.replace(struct.pack("<HHII", 259, 3, 1, 8), struct.pack("<HHII", 259, 3, 1, 99)), "f")]
    df = spark.createDataFrame(rows, "id int, media binary, error string")
    out = X.decode_pages(df).orderBy("id").collect()
    assert [(r.id, r.error is None) for r in out] == [(1, True)] + [(i, False) for i in range(2, 7)]


def page(fields, body=b"", order="<", at=8):
    """A file with body and one directory of these fields after it."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8 + len(body) + len(body) % 2) + body + b"\0" * (len(body) % 2))
    out += struct.pack(order + "H", len(fields)) + b"".join(struct.pack(order + "HHII", *f) for f in fields)
    return bytes(out + b"\0\0\0\0")


def fields(width=8, height=2, bits=8, scheme=1, rows=2, length=16, predictor=1, offset=8):
    return [(256, 4, 1, width), (257, 4, 1, height), (258, 3, 1, bits), (259, 3, 1, scheme), (273, 4, 1, offset), (278, 4, 1, rows), (279, 4, 1, length), (317, 3, 1, predictor)]


BOMB = zlib.compress(b"\0" * 300_000_000)[:300_000]
BROKEN = {
    "no width": page(fields(width=0), b"x" * 16),
    "no height": page(fields(height=0), b"x" * 16),
    "no rows in a strip": page(fields(rows=0), b"x" * 16),
    "too large": page(fields(width=2**31, height=2**31), b"x" * 16),
    "bomb": page(fields(scheme=8, length=len(BOMB), width=2**14, height=2**15), BOMB),
    "too short": page(fields(length=3), b"x" * 16),
    "strips missing": page(fields(rows=1), b"x" * 16),
    "empty list": page([(256, 4, 0, 0), *fields()[1:]], b"x" * 16),
    "no strips": page(fields()[:4], b"x" * 16),
    "predictor": page(fields(predictor=9), b"x" * 16),
    "values beyond the end": page([*fields()[:4], (273, 4, 2**30, 8), *fields()[5:]], b"x" * 16),
    "lzw": page(fields(scheme=5), b"\xff" * 16),
    "deflate": page(fields(scheme=8), b"\xff" * 16),
}


@pytest.mark.parametrize("name", BROKEN)
def test_broken_pages_have_errors(name):
    (found,) = X.pages(BROKEN[name])
    assert found.error and found.samples is None


def test_a_bomb_is_not_inflated():
    """A strip that would inflate to 300 MB, where 16 bytes are wanted."""
    (found,) = X.pages(page(fields(scheme=8, length=len(BOMB)), BOMB))
    assert found.samples == b"\0" * 16


def test_walk_goes_on_after_a_broken_page():
    data = bytearray(X.tiff([np.full((2, 8), i, np.uint8) for i in range(3)]))
    starts, at = [], struct.unpack_from("<I", data, 4)[0]
    while at:
        starts.append(at)
        (n,) = struct.unpack_from("<H", data, at)
        (at,) = struct.unpack_from("<I", data, at + 2 + 12 * n)
    struct.pack_into("<I", data, starts[1] + 10, 0)  # the second page's width
    found = list(X.pages(bytes(data)))
    assert [p.error is None for p in found] == [True, False, True] and [p.page for p in found] == [0, 1, 2]
    struct.pack_into("<I", data, starts[2] + 2 + 12 * 10, starts[0])  # a loop
    assert len(list(X.pages(bytes(data)))) == 3


@pytest.mark.parametrize("bits", [1, 2, 4])
@pytest.mark.parametrize("scheme", [X.PLAIN, X.PACKBITS])
def test_few_bits(bits, scheme):
    values = np.random.default_rng(bits).integers(0, 1 << bits, (3, 11)).astype(np.uint8)
    rows = [np.packbits(np.unpackbits(r[:, None], axis=1)[:, 8 - bits :].ravel()).tobytes() for r in values]
    body = X.PACK[scheme](b"".join(rows))
    (found,) = X.pages(page(fields(width=11, height=3, bits=bits, scheme=scheme, rows=3, length=len(body)), body))
    assert found.samples == values.tobytes() and found.bits == bits


@pytest.mark.parametrize("order", ["<", ">"])
def test_floating_point_predictor(order):
    values = np.linspace(-3, 7, 24).astype("<f4").reshape(2, 12)
    high_first = values.astype(">f4").view(np.uint8).reshape(2, 12, 4).transpose(0, 2, 1).reshape(2, 48)
    body = np.diff(high_first, axis=1, prepend=np.zeros((2, 1), np.uint8)).astype(np.uint8).tobytes()
    own = [f if f[1] == 4 or order == "<" else (*f[:3], f[3] << 16) for f in fields(width=12, bits=32, length=96, predictor=3)]
    (found,) = X.pages(page(own, body, order))
    assert found.samples == values.tobytes()


def test_registered_query_and_failed_pages(spark, docs):
    from llm_data import SF

    from leafmill.llm.queries import op8_tiff

    got = {r.doc_id: r for r in op8_tiff(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        n, payload = X.text_payload(r.text)
        own = got[r.doc_id]
        assert (own.n_bytes, own.payload_bytes, own.payload_sha256, own.tail_crc32, own.error) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), None)
    media = X.encode_media(docs(["a" * (X.ROW * X.PAGE_ROWS + 1)])).select("doc_id", F.expr("overlay(media placing X'ffff' from 11)").alias("media"))
    (row,) = X.text_features(X.decode_pages(media)).collect()
    assert row.error and row.payload_sha256 is None


def test_equal_texts_equal_values(docs):
    out = X.encode_media(docs(["same", "same"])).select(F.sha2("media", 256).alias("h")).distinct().count()
    assert out == 1
