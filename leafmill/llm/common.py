"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The six characters that count as white space in the byte-level contracts.
ASCII_SPACE = r"[\x20\x09-\x0D]"

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir. Where there is none, a local session gets one of its
    own; on a cluster that would be a folder that the executors can't see, so it is an error there."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if own.isDefined():
            return own.get()
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="leafmill-")
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    return at


def store(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there, and a lost executor costs nothing before it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/leafmill-{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_rows(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A few rows of the driver as a DataFrame. They go through Arrow: a list of tuples is read by Python workers, which have a
    daemon of their own in each executor and stay beside the next stages."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)], schema=arrow), schema)


def private_names(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that clash with no column of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        own = f"__{name}"
        while own.lower() in taken:
            own += "_"
        taken.add(own.lower())
        out.append(own)
    return out


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def hashed_rank(df: DataFrame, share: Column, keys: list[Column], rank: str, label: str) -> DataFrame:
    """df in the order of keys, with column rank: 0, 1, 2 ... without a gap over the whole table.

    share, from 0 to under 1, grows with the first of keys and is evenly spread, as a hash is: so the ranges of keys are cut
    without sampling, a few for each shuffle partition. The sorted rows are written to the shared folder with their place
    in their range; only the ranges' row counts are added up over the whole table. keys must order the rows totally, up to
    rows that are equal in every column.
    """
    spark = df.sparkSession
    part, place, start = private_names(df, "part", "place", "start")
    n_parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn(part, F.floor(share * n_parts).cast("int")).repartition(part)
    stored = store(dealt.withColumn(place, F.row_number().over(Window.partitionBy(part).orderBy(*keys)) - 1), label)
    counts = sorted((r[0], r[1]) for r in stored.groupBy(part).count().collect())  # n_parts rows at most
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    offsets = local_rows(spark, starts, T.StructType([T.StructField(part, T.IntegerType()), T.StructField(start, T.LongType())]))
    return stored.join(F.broadcast(offsets), part).withColumn(rank, F.col(start) + F.col(place)).drop(part, place, start)


def join_known(parts: list[list[str]], known: dict[str, bytes], learn: Callable[[list[str]], dict[str, bytes]]) -> list[bytes]:
    """The values of each part's pieces joined; what isn't known is learnt for all parts together."""
    values = [list(map(known.get, p)) for p in parts]
    gaps = [i for i, v in enumerate(values) if None in v]
    new = {c for i in gaps for c, v in zip(parts[i], values[i]) if v is None}
    if new:
        found = learn(list(new))
        for i in gaps:
            values[i] = [found[c] if v is None else v for c, v in zip(parts[i], values[i])]
    return [b"".join(v) for v in values]


def slices(batches: Iterator, text_column: int, most: int, rows: int = 1 << 30) -> Iterator:
    """The batches cut into slices of at most so many bytes of text and rows; a longer text is a slice of its own."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.binary_length(batch.column(text_column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = min(max(at + 1, int(np.searchsorted(ends, before + most, "right"))), at + rows)
            yield batch.slice(at, to - at)
            at = to


def remember(cache: dict[str, bytes], found: dict[str, bytes], most: int) -> None:
    """Add found to the cache, which has at most most entries: the first third, which common pieces got into early, stays."""
    if len(cache) + len(found) > most:
        first = list(islice(cache.items(), most // 3))
        cache.clear()
        cache.update(first)
    cache.update(islice(found.items(), max(0, most - len(cache))))


def releasing(batches: Iterator) -> Iterator:
    """The batches, and at the end of the task the worker's free memory back to the system: workers outlive tasks, and theirs
    stands beside the memory of the next stages."""
    yield from batches
    gc.collect()
    try:
        import pyarrow

        pyarrow.default_memory_pool().release_unused()
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def byte_table(separators: bytes, lower: bool = False):
    """What split_tokens maps bytes to: separators to a space, A-Z to lower case if asked."""
    import numpy as np

    out = np.arange(256, dtype=np.uint8)
    if lower:
        out[65:91] += 32
    out[np.frombuffer(separators, np.uint8)] = 32
    return out


def split_tokens(texts, table):
    """The maximal runs of bytes that the table doesn't map to a space, of all texts of an Arrow string array one after
    another, as a string array, and how many each text has. A null text has none."""
    import numpy as np
    import pyarrow as pa

    texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    data = table[np.frombuffer(texts.buffers()[2], np.uint8)[first:last]] if last > first else np.zeros(0, np.uint8)
    offsets -= first
    inside = data != 32
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < data.size]  # a text's first token begins at its head, whatever came before
    begins[heads] = inside[heads]
    at = np.flatnonzero(begins)
    gaps = np.flatnonzero(~inside)
    starts = np.append(at - np.searchsorted(gaps, at), data.size - gaps.size).astype(np.int32)
    tokens = pa.StringArray.from_buffers(len(at), pa.py_buffer(starts), pa.py_buffer(data[inside]))
    return tokens, np.diff(np.searchsorted(at, offsets))
