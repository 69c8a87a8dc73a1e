"""The registered queries of this folder and their SQL: thin wrappers that run an operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import content_sort, divide_skip, hilbert, html_extract, hybrid_search, license_scan, line_runs, periodic_runs, pfor, poisson_mix, segment_bpe, string_kernel, tiff
from .common import store, table
from .sql import ORACLES


def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op2_pfor_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfor.read_ids(pfor.write_ids(table(spark, sf_dir, "documents", "doc_id", "text")))


def op3_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = string_kernel.train(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    return string_kernel.identify(table(spark, sf_dir, "documents", "doc_id", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hilbert.hilbert_shards(table(spark, sf_dir, "documents"), n_shards=8)
    return out.select(
        "doc_id",
        "size",
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
    )


def op5_segment_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = segment_bpe.bpe_both(table(spark, sf_dir, "documents", "doc_id", "text")).drop("text")
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divide_skip.jaccard_join(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "n_shingles", "component_id", "n_links")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = store(tiff.encode_media(table(spark, sf_dir, "documents", "doc_id", "text")), "tiff", compression="uncompressed")
    files = stored.select("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    return tiff.text_features(tiff.decode_pages(files))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.exact_dedup(table(spark, sf_dir, "documents", "doc_id", "text"), with_text=False)


def op10_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = poisson_mix.poisson_mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "repeats", "copy_no", "position", F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("text_md5"))


def _with_planted_run(docs: DataFrame) -> DataFrame:
    """The contract's runs: in a tenth of the documents by hash, the words from the a-th on repeat the p words that stand there."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def planted(ws: Column) -> Column:
        n = F.size(ws)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        again = F.flatten(F.array_repeat(F.slice(ws, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(ws, F.lit(1), a), F.slice(again, F.lit(1), n - a)), " "))

    # the words are bound once
    text = F.when(h % 10 == 0, F.get(F.transform(F.array(words), planted), F.lit(0))).otherwise(F.col("text"))
    return docs.withColumn("text", text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _with_planted_run(table(spark, sf_dir, "documents", "doc_id", "text"))
    found = periodic_runs.periodic_runs(docs, with_text=False)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], F.concat(r["period"].cast("string"), F.lit("\n"))))
    return found.withColumn("longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.start")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"),
        F.expr("1000 * longest.length div -longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )


def op12_hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid_search.rank_documents(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op13_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_runs.dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"), with_text=False)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_main_text, op2_pfor_ids, op3_string_kernel, op4_hilbert_shards, op5_segment_bpe, op6_jaccard_join, op7_license_scan, op8_tiff, op9_exact_dedup, op10_poisson_mix,
        op11_periodic_runs, op12_hybrid_search, op13_line_runs,
    )
}
