"""The corpus pipeline: each stage takes all that its predecessor kept.

A stage is (name, function) and a function takes (spark, docs, sf_dir); all but the last return the columns of documents.
run() writes each stage's rows to the shared folder and reads them again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import content_sort, divide_skip, poisson_mix, segment_bpe, string_kernel
from leafmill.llm.common import DOCUMENT_COLUMNS, store, table

#: A document in which no language has this share is rejected, as is one without a letter.
LEAST_SCORE = 1 / 3
#: Near duplicates: words in a shingle and similarity in per cent.
WORDS, SIMILARITY = 5, 80
#: Ids of dropped documents are broadcast up to so many; more of them are joined by a shuffle.
MOST_BROADCAST = 1_000_000
#: Rows of an Arrow batch: a batch of whole texts stands in the JVM's buffers and in the worker at once, in each task.
ARROW_ROWS = 1000

# No SQL: the first stage is a fitted classifier. tests/llm/test_pipeline.py holds run() against a plain version.
ORACLE_SQL = None


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows of an Arrow batch to ARROW_ROWS. It holds when a stage's result is run, so it stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, ARROW_ROWS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified."""
    small_batches(spark)
    model = string_kernel.train(docs)
    found = string_kernel.identify(docs, model)
    return found.where((F.col("lang_pred") != string_kernel.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*DOCUMENT_COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return content_sort.exact_dedup(docs).where("kept").select(*DOCUMENT_COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near duplicates. Rows with a null id stay."""
    small_batches(spark)
    found = divide_skip.jaccard_join(docs, k=WORDS, num=SIMILARITY, den=100, links=False)
    dropped = store(found.where("doc_id is not null and not is_first").select("doc_id").distinct(), "dropped")
    if dropped.count() <= MOST_BROADCAST:
        dropped = F.broadcast(dropped)
    return docs.join(dropped, "doc_id", "left_anti").select(*DOCUMENT_COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for, in a random order."""
    return poisson_mix.poisson_mix(docs).select(*DOCUMENT_COLUMNS)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each whole text, and whether decoding them gives the text again."""
    small_batches(spark)
    both = segment_bpe.bpe_both(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    return both.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == text).alias("round_trip"), "ids")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("bpe", bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
