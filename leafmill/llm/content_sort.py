"""Exact dedup by content sort.

Texts are equal when they are identical after every character of [\\x20\\x09-\\x0D] is deleted. Sampled splitters range-
partition the normalised texts, Spark's external sort puts equal ones side by side, and a window walks the sorted run and
compares each whole text with its neighbour. Of equal texts the row with the most code points in the original text stays,
then the smallest doc_id.

A splitter is (first 64 characters, 64-bit hash of the whole text): what the sampler sends to the driver stays small
however long the texts are, and texts that share a long opening still spread. A text with more than a share of 1/HOT of the
rows, or more than HOT_ROWS, is dealt to runs of about so many rows each by a hash of the row; the heads of these runs are
sorted and compared once more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_SPACE, private_names, store

#: A text is hot from a share of 1/HOT of all rows, and from HOT_ROWS rows however many there are.
HOT, HOT_ROWS = 2000, 100_000
#: What is known of hot texts and their runs is broadcast up to so many bytes; beyond that it is joined by a shuffle.
MOST_BROADCAST, RUN_BYTES = 32 << 20, 256

OUTPUT = ("keep_id", "group_size", "kept", "text_sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """docs with keep_id, group_size, kept and text_sha256; without the text column if with_text is false.

    Nulls: a null text counts as empty; empty texts are equal to each other. A null id sorts after all others.
    Ties and repeated rows: exactly one row of a group has kept = true, also where rows repeat as a whole.
    Rows that are equal in all columns go to one run.
    Very long texts: compared whole. Empty table: empty result. Extra columns stay; one that has the name of an output
    column is replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in OUTPUT])
    norm, size, head, digest, salt, hot, run_id, run_rows, run_no, head_text, big = private_names(
        docs, "norm", "size", "head", "digest", "salt", "hot", "run_id", "run_rows", "run_no", "head_text", "big"
    )
    text = F.coalesce(F.col(text_col), F.lit(""))
    normalised = F.regexp_replace(text, ASCII_SPACE, "")
    keyed = docs.withColumn(norm, normalised).withColumn(digest, F.xxhash64(norm))

    n_rows = docs.count()
    most = max(1.0, min(n_rows / HOT, float(HOT_ROWS)))
    # hot texts and their runs are 2 n / most at most: each text has more than most rows, and each run but one about as many
    few = F.broadcast if 2 * n_rows / most * RUN_BYTES <= MOST_BROADCAST else (lambda df: df)
    hot_texts = keyed.groupBy(digest).count().where(F.col("count") > most).select(F.col(digest), F.ceil(F.col("count") / most).cast("int").alias(hot))
    others = [c for c in docs.columns if c != text_col]
    keyed = (
        keyed.join(few(hot_texts), digest, "left")
        .withColumn(salt, F.when(F.col(hot).isNotNull(), F.pmod(F.xxhash64(*others), F.col(hot)).cast("int")).otherwise(F.lit(0)))
        .withColumn(hot, F.col(hot).isNotNull())
        .withColumn(size, F.length(text))
        .withColumn(head, F.substring(norm, 1, 64))
    )
    # one copy of the text moves: the whole one where it is wanted later, else the normalised one
    keyed = keyed.drop(norm if with_text else text_col)

    run = Window.partitionBy(head, digest, salt, norm)
    order = [F.desc(size), F.asc_nulls_last(id_col)]
    whole = run.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = (
        (keyed.repartitionByRange(head, digest, salt).withColumn(norm, normalised) if with_text else keyed.repartitionByRange(head, digest, salt))
        .withColumn(run_no, F.row_number().over(run.orderBy(*order)))
        .withColumn(run_id, F.first(id_col).over(whole))
        .withColumn(run_rows, F.count(F.lit(1)).over(whole))
        .withColumn("text_sha256", F.sha2(F.col(norm), 256))
        .withColumn(head_text, F.when(F.col(hot) & (F.col(run_no) == 1), F.col(norm)))
        .drop(norm, head, digest)
    )
    runs = store(runs, "content-sort")

    # the heads of hot texts' runs: sorted and compared whole as above
    whole_text = Window.partitionBy(head, "text_sha256", head_text)
    best = whole_text.orderBy(F.desc(size), F.asc_nulls_last(run_id), F.asc(salt)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    merged = (
        runs.where(F.col(head_text).isNotNull())
        .withColumn(head, F.substring(head_text, 1, 64))
        .repartitionByRange(head, F.col("text_sha256"))
        .withColumn("keep_id", F.first(run_id).over(best))
        .withColumn(big, F.first(salt).over(best))
        .withColumn("group_size", F.sum(run_rows).over(whole_text))
        .select("text_sha256", salt, "keep_id", "group_size", big)
    )
    cold = (
        runs.where(~F.col(hot))
        .withColumn("keep_id", F.col(run_id))
        .withColumn("group_size", F.col(run_rows))
        .withColumn("kept", F.col(run_no) == 1)
    )
    warm = (
        runs.where(F.col(hot))
        .join(few(merged), ["text_sha256", salt])  # a row for each run
        .withColumn("kept", (F.col(run_no) == 1) & (F.col(salt) == F.col(big)))
    )
    columns = [*(c for c in docs.columns if with_text or c != text_col), *OUTPUT]
    return cold.select(*columns).unionByName(warm.select(*columns))
