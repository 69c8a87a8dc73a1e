from __future__ import annotations

import hashlib
import os
import struct
import zipfile
import zlib

import pytest
from data_dir import SF
from pyspark.sql import functions as F

from leafmill.operators import zip_sink
from leafmill.plans import queries

SCHEMA = "archive_id string, seq int, path string, data binary"


def stored(entries):
    """An archive as the format's description has it: no times, names in UTF-8."""
    body, central = b"", b""
    for path, data in entries:
        name, at = path.encode(), len(body)
        common = struct.pack("<HHHHHIIIHH", 20, 0x0800, 0, 0, 0, zlib.crc32(data), len(data), len(data), len(name), 0)
        body += b"PK\x03\x04" + common + name + data
        central += b"PK\x01\x02" + struct.pack("<H", 20) + common + struct.pack("<HHHII", 0, 0, 0, 0, at) + name
    return body + central + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, len(entries), len(entries), len(central), len(body), 0)


def test_archives_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(zip_sink, "PIECE", 1000)
    rows = [("a", 5, "f/x.md", b"hello"), ("a", 2, "f/é.bin", b""), ("a", 9, "none", None), ("b c", 0, "y", bytes(range(256)) * 37), ("b c", 1, "z", b"z" * 1000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    zip_sink.write_archives(df, str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == ["a.zip", "b c.zip"]
    for name in ("a", "b c"):
        entries = [(p, d or b"") for a, s, p, d in sorted(rows[:3] + rows[3:], key=lambda r: r[1]) if a == name]
        assert (tmp_path / f"{name}.zip").read_bytes() == stored(entries)
        with zipfile.ZipFile(tmp_path / f"{name}.zip") as z:
            assert z.testzip() is None and {n: z.read(n) for n in z.namelist()} == dict(entries)


def test_a_failed_job_leaves_no_archive(spark, tmp_path):
    df = spark.createDataFrame([(f"a{n % 3}", n, f"p{n}", b"x") for n in range(60)], SCHEMA).repartition(6)
    pieces = zip_sink.archive_pieces(df).withColumn("piece", F.when(F.col("archive") == "a2", F.raise_error(F.lit("lost"))).otherwise(F.col("piece")))
    with pytest.raises(Exception, match="lost"):
        pieces.repartition(8).write.format("zip_files").mode("append").save(str(tmp_path))
    assert os.listdir(tmp_path) == []


@pytest.mark.parametrize(
    "rows, why",
    [([("a", 0, "x", b""), ("a", 1, "x", b"")], "duplicate path"), ([("a", 0, "../x", b"")], "unsafe path"), ([("a", 0, "x", b""), ("a", 0, "y", b"")], "repeated order"), ([("a", None, "x", b"")], "repeated order"), ([("../a", 0, "x", b"")], "unsafe archive"), ([(None, 0, "x", b"")], "unsafe archive")],
)
def test_refused(spark, tmp_path, rows, why):
    with pytest.raises(Exception, match=why):
        zip_sink.write_archives(spark.createDataFrame(rows, SCHEMA), str(tmp_path))
    assert os.listdir(tmp_path) == []


def test_empty(spark, tmp_path):
    zip_sink.write_archives(spark.createDataFrame([], SCHEMA), str(tmp_path))
    assert os.listdir(tmp_path) == []


def test_query(spark):
    archives = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        archives.setdefault(f"{r.source}-{r.doc_id // 1000}", []).append((f"{r.source}/{r.doc_id}.md", (r.text or "").encode()))
    want = {a: (len(whole := stored(e)), hashlib.sha256(whole).hexdigest()) for a, e in archives.items()}
    assert {r.archive_id: (r.n_bytes, r.bytes_sha256) for r in queries.archive_files(spark, SF).collect()} == want
    # and the archives that are packed into a row are the same bytes
    packed = zip_sink.zip_archives(queries._entries(spark, SF)).select("archive_id", F.sha2("bytes", 256).alias("h")).collect()
    assert {r.archive_id: r.h for r in packed} == {a: h for a, (_, h) in want.items()}
