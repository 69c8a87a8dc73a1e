"""Log entries in one order over the whole table, as numbered lines and as text files that follow one another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import kept


def numbered(entries: DataFrame, *order: str) -> DataFrame:
    """entries with line_no, from 1 without a gap in the order of these columns, which tell entries apart.

    Ranges of the order are sorted by themselves; only their numbers of rows, one for each range, are added up. Entries with
    the same order come one after another in either order. Nulls come first.
    """
    part, at, first = "_part", "_at", "_first"
    ranged = entries.repartitionByRange(*order).withColumn(part, F.spark_partition_id())
    stored = kept(ranged.withColumn(at, F.row_number().over(Window.partitionBy(part).orderBy(*order))), "log")
    sizes = sorted((r[0], r[1]) for r in stored.groupBy(part).count().collect())  # a row for each shuffle partition at most
    starts, total = [], 0
    for p, n in sizes:
        starts.append((p, total))
        total += n
    offsets = entries.sparkSession.createDataFrame(starts, T.StructType([T.StructField(part, T.IntegerType()), T.StructField(first, T.LongType())]))
    return stored.join(F.broadcast(offsets), part).withColumn("line_no", F.col(first) + F.col(at)).drop(part, at, first)


def write_log(entries: DataFrame, line: Column, path: str, *order: str) -> None:
    """A folder of text files: the lines of the entries, one file after another by name, are the whole log in its order."""
    entries.repartitionByRange(*order).sortWithinPartitions(*order).select(line.alias("value")).write.text(path)

