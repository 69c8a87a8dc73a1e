"""Line dedup over levelled sorted runs.

The key of a line is the line with all of [\\x20\\x09-\\x0D] stripped at both ends and A-Z lower-cased. Keys of at least
MIN_CHARS code points that at least MIN_DOCS documents hold lose all their lines but those in the largest id that holds them.

Keys are taken as two 64-bit hashes. Documents come in batches, the largest ids first. A run is a table bucketed and sorted
by the hashes, with the number of documents of each key and the largest id among them. A batch's keys are counted, those
that a run already has with MIN_DOCS documents are taken out by a merge anti-join bucket by bucket (their owner can't change
any more, since ids only fall), and the others become a run of their own. A batch that finds runs in the lowest levels is
compacted with them to one run of the next level by full merge joins before it is written, and the last batch with all runs.
So a line that a third of all documents hold is added by the first batches only, runs are joined bucket by bucket without a
shuffle (only what comes out of one full merge join is dealt anew for the next), and each batch but the last writes one
table: a file for each bucket costs two more processes where Hadoop has no native library (chmod, for it and its checksums).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import private_names, shared_dir, store

#: The white space that is stripped, and the letters that are lower-cased.
SPACE, UPPER = " \t\n\x0b\x0c\r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_CHARS, MIN_DOCS = 20, 3
#: Batches of documents.
BATCHES = 6
#: Repeated keys, or places of dropped lines, are broadcast up to so many bytes; more of them are joined by a shuffle.
MOST_BROADCAST, KEY_BYTES, PLACE_BYTES = 16 << 20, 64, 16

OUTPUT = ("n_lines", "n_dropped", "kept_text")


def line_key(line: Column) -> Column:
    stripped = F.btrim(line, F.lit(SPACE))
    # lower() changes A-Z only where all is ASCII, and is much faster there
    return F.when(F.octet_length(stripped) == F.length(stripped), F.lower(stripped)).otherwise(F.translate(stripped, UPPER, UPPER.lower()))


class SortedRuns:
    """Levels of runs (h1, h2, n_docs, top), each a bucketed and sorted table in the shared folder."""

    def __init__(self, spark: SparkSession, enough: int):
        self.spark, self.enough = spark, enough
        self.buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 10_000)
        self.levels: list[str | None] = []

    def names(self) -> list[str]:
        return [name for name in self.levels if name]

    def _write(self, rows: DataFrame) -> str:
        name = f"leafmill_run_{uuid.uuid4().hex}"
        rows.write.format("parquet").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{shared_dir(self.spark)}/{name}").saveAsTable(name)
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"drop table {name}")
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(self.spark)}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _fresh(self, batch: DataFrame) -> DataFrame:
        """The rows of a batch whose keys no run has settled."""
        for name in self.names():
            settled = self.spark.table(name).where(F.col("n_docs") >= self.enough).select("h1", "h2")
            batch = batch.join(settled.hint("merge"), ["h1", "h2"], "left_anti")
        return batch

    def _merged(self, rows: DataFrame, names: list[str]) -> DataFrame:
        # a join, not a union: Spark 4.1 takes the buckets of a union's tables for aligned where they are not
        for name in names:
            both = rows.alias("one").hint("merge").join(self.spark.table(name).alias("two"), F.expr("one.h1 = two.h1 and one.h2 = two.h2"), "full")
            n_docs = F.coalesce(F.col("one.n_docs"), F.lit(0)) + F.coalesce(F.col("two.n_docs"), F.lit(0))
            rows = both.select(F.coalesce("one.h1", "two.h1").alias("h1"), F.coalesce("one.h2", "two.h2").alias("h2"), n_docs.alias("n_docs"), F.greatest("one.top", "two.top").alias("top"))
        return rows

    def add(self, batch: DataFrame) -> None:
        """Add a batch of (h1, h2, n_docs, top) whose documents come before those of all earlier batches."""
        level = next((k for k, name in enumerate(self.levels) if name is None), len(self.levels))
        lower = [name for name in self.levels[:level] if name]
        run = self._write(self._merged(self._fresh(batch), lower))
        self._drop(lower)
        self.levels[: level + 1] = [*[None] * level, run]

    def compacted(self, last: DataFrame | None = None) -> DataFrame:
        """All runs as one, with a last batch that comes before those of all runs. It reads the runs, so use it before close()."""
        names = self.names()
        if last is not None:
            return self._merged(self._fresh(last), names)
        return self._merged(self.spark.table(names[0]), names[1:])

    def close(self) -> None:
        self._drop(self.names())
        self.levels = []


def _counted(keys: DataFrame, batch: int) -> DataFrame:
    """The keys of a batch with the number of documents that hold them and the largest id among these."""
    holders = keys.where(F.col("batch") == batch).select("h1", "h2", "doc").distinct()
    return holders.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("top"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, n_batches: int = BATCHES, with_text: bool = True) -> DataFrame:
    """docs with n_lines (before dropping), n_dropped and kept_text, the lines that stay joined by \\n.

    Nulls: a null text counts as empty, which is one empty line. Rows with a null id are one document whose id comes before
    all others. Ties and repeated rows: rows that share an id count as one document, and each of them keeps the lines that
    this id owns. Very long texts: whole lines count, however long. A line that one document repeats counts once for it, and
    stays or goes as often as it stands there. Empty table: empty result. Extra columns stay; one that has the name of an
    output column is replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop(*[c for c in docs.columns if c.lower() in OUTPUT])
    own_id, own_text, places = private_names(docs, "own_id", "own_text", "places")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumn(own_id, F.col(id_col)).withColumn(own_text, F.xxhash64(text))

    cuts = docs.select(F.percentile_approx(F.col(id_col), [k / n_batches for k in range(1, n_batches)], 10_000)).first()[0] or []  # n_batches - 1 ids
    batch = F.lit(0)
    for cut in sorted(set(cuts)):
        batch = batch + F.when(F.coalesce(F.col(own_id) > cut, F.lit(False)), 0).otherwise(1)
    line = keyed.select(own_id, own_text, batch.cast("int").alias("batch"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    key = line_key(F.col("line"))
    line = line.where(F.length(F.btrim("line", F.lit(SPACE))) >= min_chars).select(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"), F.col(own_id).alias("doc"), F.col(own_text).alias("body"), "pos", "batch")
    # the batches lie one after another in each file, so that a batch's pages are found by their bounds
    keys = store(line.sortWithinPartitions("batch"), "line-keys")

    runs = SortedRuns(spark, min_docs)
    for n in range(n_last := len(set(cuts))):
        runs.add(_counted(keys, n))
    repeated = store(runs.compacted(_counted(keys, n_last)).where(F.col("n_docs") >= min_docs).select("h1", "h2", "top"), "line-repeated")
    runs.close()

    few = F.broadcast if repeated.count() * KEY_BYTES <= MOST_BROADCAST else (lambda df: df)
    lost = keys.join(few(repeated), ["h1", "h2"]).where(~F.col("doc").eqNullSafe(F.col("top")))
    lost = store(lost.groupBy("doc", "body").agg(F.collect_set("pos").alias(places)), "line-places")
    size = lost.agg(F.sum(PLACE_BYTES * (F.size(places) + 4))).first()[0] or 0
    few = F.broadcast if size <= MOST_BROADCAST else (lambda df: df)
    found = keyed.join(few(lost), F.col(own_id).eqNullSafe(F.col("doc")) & (F.col(own_text) == F.col("body")), "left")
    # the lines are bound once and taken by their places
    rest = lambda lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(places)), lambda i: F.get(lines, i)), "\n")
    kept = F.when(F.col(places).isNull(), text).otherwise(F.get(F.transform(F.array(F.split(text, "\n", -1)), rest), F.lit(0)))
    return found.select(
        *[c for c in docs.columns if with_text or c != text_col],
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size(places), F.lit(0)).cast("long").alias("n_dropped"),
        kept.alias("kept_text"),
    )
