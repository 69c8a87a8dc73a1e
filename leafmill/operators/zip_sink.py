"""Stored ZIP archives: names, checksums and offsets by Spark, one archive's bytes by one small function."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..sources import zip_files

# Limits of the format without its 64-bit extension, and the fields of its headers.
MOST_16, MOST_32 = 65_535, 4_294_967_295
VERSION, UTF8_NAMES, STORED = 20, 0x0800, 0
LOCAL_MARK, CENTRAL_MARK, END_MARK = 0x04034B50, 0x02014B50, 0x06054B50


def safe_path(path: Column) -> Column:
    """Neither empty nor absolute, without drive, backslash, control character, empty part or `..`."""
    parts = F.split(path, "/")
    bad = path.startswith("/") | path.rlike(r"^[A-Za-z]:|\\|[\x{0}-\x{1f}\x{7f}]") | F.exists(parts, lambda p: p.isin("", ".."))
    return F.coalesce((path != "") & ~bad, F.lit(False))


def with_offsets(entries: DataFrame, archive: str = "archive_id", order: str = "seq") -> DataFrame:
    """entries (archive, order, path, data) with crc, size, local_offset and central_offset of each."""
    run = Window.partitionBy(archive).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    name, size = F.octet_length("path"), F.coalesce(F.octet_length("data"), F.lit(0))
    return entries.select(
        "*",
        F.crc32(F.coalesce(F.col("data").cast("binary"), F.lit("").cast("binary"))).alias("crc"),
        size.cast("long").alias("size"),
        F.coalesce(F.sum(30 + name + size).over(run), F.lit(0)).cast("long").alias("local_offset"),
        F.coalesce(F.sum(46 + name).over(run), F.lit(0)).cast("long").alias("central_offset"),
    )


#: An entry's data goes to the sink in pieces of at most so many bytes.
PIECE = 8 << 20


def _little(value: Column | int, size: int) -> Column:
    """A number as so many bytes, the lowest first."""
    digits = F.lpad(F.hex((F.lit(value) if isinstance(value, int) else value).cast("long")), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * k - 1, 2) for k in range(size, 0, -1)]))


def archive_pieces(entries: DataFrame, archive: str = "archive_id", order: str = "seq") -> DataFrame:
    """archive, at, piece: the bytes of each archive in pieces with their places, for the sink zip_files.

    Offsets are summed over the entries' sizes alone, of which the format allows 65,535 an archive; data stays where it is
    and may be larger than a task's memory as a whole. order tells an archive's entries apart. Null data is empty. An unsafe
    or repeated path, a repeated or null order, an archive that is no file name and what the format can't hold stop the job.
    """
    data = F.coalesce(F.col("data").cast("binary"), F.lit("").cast("binary"))
    own = entries.select(F.col(archive).cast("string").alias("archive"), F.col(order).alias("seq"), "path", data.alias("data"))
    small = own.select("archive", "seq", "path", F.octet_length("data").cast("long").alias("size"), F.crc32("data").alias("crc"))
    name = F.octet_length("path")
    same, run, every = Window.partitionBy("archive", "path"), Window.partitionBy("archive").orderBy("seq"), Window.partitionBy("archive")
    before = run.rowsBetween(Window.unboundedPreceding, -1)
    facts = small.select(
        "*",
        F.coalesce(F.sum(30 + name + F.col("size")).over(before), F.lit(0)).alias("local_offset"), F.coalesce(F.sum(46 + name).over(before), F.lit(0)).alias("central_offset"),
        F.sum(30 + name + F.col("size")).over(every).alias("body"), F.sum(46 + name).over(every).alias("central"), F.count(F.lit(1)).over(every).alias("n"), F.row_number().over(run).alias("nr"),
        F.lag("seq").over(run).eqNullSafe(F.col("seq")).alias("again"), F.count(F.lit(1)).over(same).alias("n_same"),
    )
    problem = (
        F.when(~safe_path(F.col("path")), "unsafe path").when(F.col("n_same") > 1, "duplicate path").when(F.col("seq").isNull() | (F.col("again") & (F.col("nr") > 1)), "repeated order")
        .when(~safe_path(F.col("archive")) | F.col("archive").contains("/"), "unsafe archive").when(name > MOST_16, "long path").when(F.col("n") > MOST_16, "many entries").when(F.col("body") + F.col("central") > MOST_32, "large archive")
    )
    facts = facts.withColumn("path", F.when(problem.isNull(), F.col("path")).otherwise(F.raise_error(F.concat(problem, F.lit(": "), F.coalesce("path", F.lit(""))))))

    small16, raw = (lambda *values: F.concat(*[_little(v, 2) for v in values])), F.col("path").cast("binary")
    common = F.concat(small16(VERSION, UTF8_NAMES, STORED, 0, 0), _little(F.col("crc"), 4), _little(F.col("size"), 4), _little(F.col("size"), 4), small16(name, 0))
    local = facts.select("archive", F.col("local_offset").alias("at"), F.concat(_little(LOCAL_MARK, 4), common, raw).alias("piece"))
    central = F.concat(_little(CENTRAL_MARK, 4), small16(VERSION), common, small16(0, 0, 0), _little(0, 4), _little(F.col("local_offset"), 4), raw)
    listed = facts.select("archive", (F.col("body") + F.col("central_offset")).alias("at"), central.alias("piece"))
    end = F.concat(_little(END_MARK, 4), small16(0, 0, F.col("n"), F.col("n")), _little(F.col("central"), 4), _little(F.col("body"), 4), small16(0))
    ends = facts.where("nr = 1").select("archive", (F.col("body") + F.col("central")).alias("at"), end.alias("piece"))
    starts = facts.select("archive", "seq", (F.col("local_offset") + 30 + name).alias("start"))
    cut = F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("data") - 1) / PIECE).cast("int")))
    held = own.where(F.octet_length("data") > 0).join(starts, ["archive", "seq"]).select("archive", "start", "data", cut.alias("k"))
    bodies = held.select("archive", (F.col("start") + F.col("k") * F.lit(PIECE).cast("long")).alias("at"), F.substring(F.col("data"), F.col("k") * PIECE + 1, F.lit(PIECE)).alias("piece"))
    return local.unionByName(bodies).unionByName(listed).unionByName(ends)


def write_archives(entries: DataFrame, path: str, archive: str = "archive_id", order: str = "seq") -> None:
    """A file archive.zip in the folder path for each archive, or none at all if the job fails."""
    zip_files.register(entries.sparkSession)
    os.makedirs(zip_files.folder_of(path), exist_ok=True)
    archive_pieces(entries, archive, order).write.format("zip_files").mode("append").save(path)


def zip_archives(entries: DataFrame, archive: str = "archive_id", order: str = "seq") -> DataFrame:
    """archive, n_entries, n_bytes, bytes: one stored archive each, whose entries fit in a task's memory; write_archives() is
    for larger ones.

    Entries are dealt by archive and sorted once, and packed as they stream by. An unsafe or repeated path stops the job, as
    does what the format can't hold. A null path is unsafe, null data is empty.
    """
    path = F.when(safe_path(F.col("path")), F.col("path")).otherwise(F.raise_error(F.concat(F.lit("unsafe path: "), F.coalesce("path", F.lit("")))))
    data = F.coalesce(F.col("data").cast("binary"), F.lit("").cast("binary"))
    ready = entries.select(F.col(archive), F.col(order).alias("_order"), path.alias("path"), data.alias("data"), F.crc32(data).alias("crc"))
    schema = T.StructType([entries.schema[archive], *(T.StructField(n, t) for n, t in (("n_entries", T.IntegerType()), ("n_bytes", T.LongType()), ("bytes", T.BinaryType())))])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3, 4))))
        held: list[tuple] = []  # some small archives go on together
        for name, group in groupby(rows, key=itemgetter(0)):
            whole, n = _archive(row[1:] for row in group)
            held.append((name, n, len(whole), whole))
            if len(held) == 256 or sum(h[2] for h in held) >= PIECE:
                yield batch_of(held)
                held = []
        if held:
            yield batch_of(held)

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), (kind, pa.int32(), pa.int64(), pa.binary()))], names=schema.names)

    kind = to_arrow_type(entries.schema[archive].dataType)
    return ready.repartition(archive).sortWithinPartitions(archive, "_order").mapInArrow(packed, schema)


def _archive(entries: Iterable[tuple[str, bytes, int]]) -> tuple[bytes, int]:
    """The bytes of an archive of (path, data, crc), and how many entries it has."""
    body, central, seen = bytearray(), bytearray(), set()
    for path, data, crc in entries:
        name, offset = path.encode(), len(body)
        problem = "duplicate path" if path in seen else "long path" if len(name) > MOST_16 else "large archive" if offset + len(data) > MOST_32 else "many entries" if len(seen) == MOST_16 else None
        if problem:
            raise ValueError(f"{problem}: {path}")
        seen.add(path)
        common = struct.pack("<HHHHHIIIHH", VERSION, UTF8_NAMES, STORED, 0, 0, crc, len(data), len(data), len(name), 0)
        body += struct.pack("<I", LOCAL_MARK) + common + name + data
        central += struct.pack("<IH", CENTRAL_MARK, VERSION) + common + struct.pack("<HHHII", 0, 0, 0, 0, offset) + name
    if len(body) + len(central) > MOST_32:
        raise ValueError("large archive")
    return bytes(body + central + struct.pack("<IHHHHIIH", END_MARK, 0, 0, len(seen), len(seen), len(central), len(body), 0)), len(seen)
