"""The registered queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import details
from ..functions import media as M
from ..functions import text as X
from ..functions import urls as U
from ..functions.lines import plain_lists
from ..functions.markdown import BLOCK, document_markdown, table_markdown
from ..operators import blocks as B
from ..operators import dispatch, export, islands, merge, zip_sink
from ..operators import media as media_ops
from ..operators import ordered_log as ordered_log_ops
from ..operators.families import article, course, feishu, wechat
from ..sources import block_table
from ..sources.html_nodes import SELECTED, dom_nodes
from ..sources.shared import shared_path
from ..streaming import page_collector
from ..streaming.collector import Policy, collect

#: The capture time of all exports; a real job takes it from a column.
CAPTURED = "2024-05-06 07:08:00"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.page_blocks(_table(spark, sf_dir, "pages"))


def _struct(**fields: Column) -> Column:
    """A block with these fields, the others null."""
    names = [f.split(":")[0] for f in ("type", "text", "markdown", "level", "ordered", "depth", "language", "src", "alt", "href", "rows", "images", "embedded_data_url", "source_id", "source_order")]
    return F.struct(*[fields.get(n, F.lit(None)).alias(n) for n in names]).cast(BLOCK)


def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir).select("page_id", "pos", "type", "level", "text")


def page_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = B.page_areas(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return areas.where("blocks is not null").select("page_id", "score", "n_blocks")


def page_blocks_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of pages by the table function, in SQL."""
    block_table.register(spark)
    _table(spark, sf_dir, "pages").createOrReplaceTempView("leafmill_pages")
    return spark.sql("select p.page_id, b.pos, b.type, b.level, b.text from leafmill_pages p, lateral extract_blocks(p.html, p.url) b")


def promoted_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of which the second paragraph, the article or a missing element was selected."""
    which = F.col("page_id") % 3
    pages = _table(spark, sf_dir, "pages")
    found = B.selected_areas(pages, F.when(which == 0, "p").when(which == 1, "article").otherwise("table"), F.when(which == 0, 1).otherwise(0))
    text = F.array_join(F.transform("blocks", lambda b: b["text"]), "\n")
    return found.select("page_id", "n_selected", "promoted", F.size("blocks").alias("n_blocks"), F.md5(text).alias("text_md5"))


def page_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir).groupBy("type").agg(F.count(F.lit(1)).alias("n_blocks"), F.countDistinct("page_id").alias("n_pages"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, title, blocks of each page with blocks."""
    title = X.normalize_text(X.decoded(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)))
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", F.coalesce(F.nullif(title, F.lit("")), F.lit("Web Clip")).alias("title"), "html")
    areas = B.page_areas(pages).where("blocks is not null")
    block = lambda b: _struct(type=b["type"], text=b["text"], level=b["level"], src=b["src"], alt=b["alt"], href=b["href"])
    return areas.select("page_id", "url", "title", F.transform("blocks", block).alias("blocks"))


def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return docs.select("page_id", document_markdown(F.col("title"), F.col("url"), X.captured_at(F.lit(CAPTURED).cast("timestamp")), F.col("blocks")).alias("markdown"))


def page_export_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = X.decoded(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    return _table(spark, sf_dir, "pages").select("page_id", X.export_names(title, F.lit(CAPTURED).cast("timestamp")).alias("names")).select("page_id", "names.*")


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = dom_nodes(_table(spark, sf_dir, "pages"), tags=frozenset(("a",))).where("tag = 'a'")
    text = X.normalize_text(F.col("text"))
    href = U.absolute_url(F.element_at("attrs", F.lit("href")), F.col("url"))
    return nodes.select("page_id", F.row_number().over(Window.partitionBy("page_id").orderBy("pre")).alias("n"), text.alias("text"), U.log_safe(href).alias("href"))


def site_family_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, and the same paths as if each family's site had them."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    hosts = F.explode(F.array(*map(F.lit, ("mp.weixin.qq.com", "www.scys.com", "a.feishu.cn", "FEISHU.CN.", "xfeishu.cn", "")))).alias("host")
    paths = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/articleDetail/xq_topic/"), "page_id")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("/course/detail/"), "page_id")).otherwise(F.lit("/x"))
    variants = pages.select("page_id", "url", hosts).select("page_id", "host", F.when(F.col("host") == "", F.col("url")).otherwise(F.concat(F.lit("https://"), "host", paths)).alias("url"))
    policies = spark.createDataFrame(list(U.POLICIES), U.POLICY_SCHEMA)
    return variants.withColumn("adapter", U.site_family(F.col("url"))).join(F.broadcast(policies), "adapter").select("page_id", "host", "adapter", "merge_mode", "stable_rounds", "wait_ms")


def media_url_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses made of the numbers of events."""
    e = _table(spark, sf_dir, "events").select("event_id", "user_id")
    host = (
        F.when(F.col("event_id") % 7 == 0, F.concat_ws(".", F.col("event_id") % 256, F.col("user_id") % 256, F.lit(1), F.lit(2)))
        .when(F.col("event_id") % 7 == 1, F.concat_ws(".", F.lit(192), F.col("user_id") % 256, F.lit(0), F.lit(9)))
        .when(F.col("event_id") % 7 == 2, F.concat(F.lit("h"), "user_id", F.lit(".local")))
        .when(F.col("event_id") % 7 == 3, F.lit("LocalHost."))
        .when(F.col("event_id") % 7 == 4, F.concat(F.lit("u:p@h"), "user_id", F.lit(".example.com")))
        .otherwise(F.concat(F.lit("h"), "user_id", F.lit(".example.com")))
    )
    scheme = F.when(F.col("event_id") % 11 == 0, F.lit("ftp")).otherwise(F.lit("https"))
    src = F.concat(scheme, F.lit("://"), host, F.lit("/a.png"))
    page = F.concat(F.lit("https://h"), (F.col("event_id") % 50).cast("string"), F.lit(".example.com/p"))
    asked = e.select("event_id", U.media_request(src, page).alias("r"))
    return asked.select("event_id", "r.ok", "r.reason", "r.credentials")


def log_safe_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", U.log_safe(F.col("url")).alias("safe"), U.log_safe(F.regexp_extract("url", "//(.*)", 1)).alias("bare"))


def doc_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = X.normalize_text(F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(text).alias("text_md5"), X.utf16_length(text).alias("units"))


def doc_lines_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), X.normalize_text)
    distinct = F.array_distinct(F.filter(lines, lambda line: line != ""))
    kept = _table(spark, sf_dir, "documents").select("doc_id", distinct.alias("lines")).where(F.size("lines") > 0)
    return kept.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.md5(F.array_join("lines", "\n")).alias("lines_md5"))


def doc_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", X.file_name(F.col("text")).alias("file_name"), X.title_name(F.col("text")).alias("title_name"))


def line_overlap_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole halves of each text, which share up to 30 characters, joined."""
    half = F.floor(F.length("text") / 2).cast("int")
    left = F.substring(F.col("text"), F.lit(1), half + (F.col("doc_id") % 31).cast("int"))
    right = F.substring(F.col("text"), half + 1, F.length("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", X.overlap_merge(left, right).alias("merged"))


def fragment_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounds = merge.rows_of_conversations(_table(spark, sf_dir, "conversations"))
    return merge.merge_rounds(rounds, "accumulate", "conv_id", "turn", "type string, text string")


def ordered_snapshot_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounds = merge.rows_of_conversations(_table(spark, sf_dir, "conversations"))
    return merge.merge_rounds(rounds, "ordered", "conv_id", "turn", "type string, text string")


def list_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Menus and articles as read without choosing an area: neighbouring list items become one paragraph."""
    nodes = dom_nodes(_table(spark, sf_dir, "pages"), tags=SELECTED).where(F.col("tag").isin("li", "p", "h1"))
    kind = F.when(F.col("tag") == "li", "listItem").when(F.col("tag") == "h1", "heading").otherwise("paragraph")
    rows = nodes.select("page_id", F.col("pre").alias("pos"), kind.alias("type"), X.normalize_text(F.col("text")).alias("text"), F.lit(None).cast("boolean").alias("ordered"), F.lit(None).cast("int").alias("depth")).where("text <> ''")
    merged = islands.compact_lists(islands.join_split_numbers(rows))
    return merged.groupBy("page_id", "type").agg(F.count(F.lit(1)).alias("n_blocks"), F.max("n_items").alias("most_items"), F.max(F.when(F.col("n_items") > 1, F.col("text"))).alias("list_text"))


def _word_rows(per_row: Column) -> Column:
    """The words of each whole text in rows of so many: each row's words with what parts them. One row after another is taken
    from the text, since a slice of all words for each row would be quadratic."""
    more = (per_row - 1).cast("string")
    return F.regexp_extract_all(F.coalesce("text", F.lit("")), F.concat(F.lit(r"(?:[^ \n]+[ \n]+){0,"), more, F.lit(r"}[^ \n]+")), F.lit(0))


def _cell_image() -> Column:
    """A picture in a cell beyond the first row's end."""
    return F.struct(F.concat(F.lit("i ("), "doc_id", F.lit(").png")).alias("src"), F.lit("a[b]").alias("alt"), F.lit(0).alias("row_index"), F.lit(4).alias("column_index"), F.lit(None).cast("string").alias("source_id"))


def table_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of each text in rows of one to four, with a picture in a cell beyond the first row's end."""
    rows = F.transform(_word_rows(F.col("doc_id") % 4 + 1), lambda p: F.transform(F.split(p, r"[ \n]+"), lambda w: F.concat(w, F.lit("|"))))
    return _table(spark, sf_dir, "documents").select("doc_id", table_markdown(rows, F.array(_cell_image())).alias("markdown"))


def cell_chunking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each whole text in rows of three, the last one padded."""
    rows = F.transform(_word_rows(F.lit(3)), lambda p: F.split(p, r"[ \n]+"))
    filled = _table(spark, sf_dir, "documents").select("doc_id", rows.alias("rows")).where(F.size("rows") > 0)
    last = F.element_at("rows", -1)
    padded = F.concat(last, F.array_repeat(F.lit(""), F.lit(3) - F.size(last)))
    return filled.select("doc_id", F.size("rows").cast("long").alias("n_rows"), F.size(F.filter("rows", lambda r: F.size(r) < 3)).cast("long").alias("n_short"), F.array_join(padded, " ").alias("last_row"))


_SIGNATURES = ("FFD8FF", "89504E470D0A1A0A", "474946383961", "524946460000000057454250", "00000018667479700000000061766966", "0000001866747970", "00")


def image_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with the first bytes of a kind of file before them."""
    start = F.element_at(F.array(*[F.unhex(F.lit(s)) for s in _SIGNATURES]), (F.col("doc_id") % 7 + 1).cast("int"))
    data = F.concat(start, F.coalesce("text", F.lit("")).cast("binary"))
    kinds = ("jpeg", "png", "gif", "webp", "avif", "mp4")
    return _table(spark, sf_dir, "documents").select("doc_id", data.alias("data")).select("doc_id", F.coalesce(*[F.when(M.matches(F.lit(k), F.col("data")), F.lit(k)) for k in kinds], F.lit("none")).alias("kind"))


def fifo_media_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as pictures of users' pages; every third request failed, and errors were not answered."""
    uses = _table(spark, sf_dir, "events").select(F.col("user_id").alias("page_id"), "event_id", F.col("event_type").alias("src"))
    results = uses.select("page_id", "src", F.col("event_id").alias("idx"), (F.col("event_id") % 3 != 0).alias("ok"), M.image_name(F.col("event_id"), F.lit("png")).alias("file_name")).where("src <> 'error'")
    out = media_ops.rewrite(uses, results, "event_id")
    return out.select("page_id", "event_id", F.coalesce(F.concat(F.lit("./a.assets/"), "local"), F.col("src")).alias("src"))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as entries of archives of at most a thousand each."""
    archive = F.concat_ws("-", "source", F.floor(F.col("doc_id") / 1000))
    return _table(spark, sf_dir, "documents").select(archive.alias("archive_id"), F.col("doc_id").alias("seq"), F.concat("source", F.lit("/"), "doc_id", F.lit(".md")).alias("path"), F.coalesce("text", F.lit("")).alias("data"))


def zip_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zip_sink.with_offsets(_entries(spark, sf_dir)).select("archive_id", "seq", "size", "local_offset", "central_offset")


def zip_path_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths made of documents' sources and numbers, some of them unsafe."""
    forms = F.element_at(F.array(*map(F.lit, ("%s/%s", "/%s/%s", "%s//%s", "../%s/%s", "C:%s/%s", "%s\\%s", "%s/./%s", "%s/%s/"))), (F.col("doc_id") % 8 + 1).cast("int"))
    path = F.replace(F.regexp_replace(forms, "^(.*?)%s", "$1<>"), F.lit("%s"), F.col("doc_id").cast("string"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.replace(path, F.lit("<>"), F.col("source")).alias("path")).select("doc_id", "path", zip_sink.safe_path(F.col("path")).alias("safe"))


def crc32_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zip_sink.with_offsets(_entries(spark, sf_dir)).select("archive_id", "seq", "crc")


def _page_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    names = X.export_names(F.concat_ws(" ", "page_id", "title"), F.lit(CAPTURED).cast("timestamp"))
    text = document_markdown(F.col("title"), F.col("url"), X.captured_at(F.lit(CAPTURED).cast("timestamp")), F.col("blocks"))
    return docs.where(M.has_content(F.col("blocks"))).select("page_id", names.alias("n"), text.alias("data")).select(F.col("page_id").alias("archive_id"), F.lit(0).alias("seq"), F.concat_ws("/", "n.folder_name", "n.markdown_name").alias("path"), "data")


def zip_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive for each page with its Markdown."""
    return zip_sink.zip_archives(_page_entries(spark, sf_dir)).select(F.col("archive_id").alias("page_id"), "n_entries", "n_bytes", F.sha2("bytes", 256).alias("bytes_sha256"))


def archive_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archives of documents as files, written by all tasks together and read back."""
    path = shared_path(spark, "archives")
    zip_sink.write_archives(_entries(spark, sf_dir), path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)\.zip$", 1).alias("archive_id"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("bytes_sha256"))


def coverage_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each article's text its blocks have."""
    areas = B.page_areas(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), keep_nodes=True)
    units = lambda text: X.utf16_length(X.normalize_text(text)).cast("long")
    total = lambda numbers: F.aggregate(numbers, F.lit(0).cast("long"), lambda a, b: a + b)
    articles = F.filter("nodes", lambda n: n["tag"] == "article")
    told = F.filter("nodes", lambda n: n["tag"].isin("h1", "p") & F.exists(articles, lambda a: (a["pre"] < n["pre"]) & (n["pre"] <= a["last"])))
    both = areas.select("page_id", F.transform(told, lambda n: units(n["text"])).alias("told"), F.coalesce("blocks", F.array().cast(dict(areas.dtypes)["blocks"])).alias("blocks")).where(F.size("told") > 0).select(
        "page_id", total(F.col("told")).alias("source_chars"), total(F.transform("blocks", lambda b: F.coalesce(X.utf16_length(b["text"]), F.lit(0)).cast("long"))).alias("exported_chars"),
        F.size(F.filter("blocks", lambda b: b["type"] == "image")).cast("long").alias("images"),
    )
    percent = F.when(F.col("source_chars") == 0, 100).otherwise(F.round(100 * F.col("exported_chars") / F.col("source_chars"))).cast("long")
    return both.withColumn("percent", percent).withColumn("warn", (F.col("source_chars") >= 80) & (F.col("percent") < 70))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    details = F.array(F.struct(F.lit("user").alias("key"), F.col("user_id").cast("string").alias("value")), F.struct(F.lit("tab\tkey").alias("key"), F.col("event_type").alias("value")))
    return _table(spark, sf_dir, "events").select("event_id", X.log_line(F.lit("extract"), F.concat(F.lit("event\n"), "event_type"), details).alias("line"))


def event_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details of each event as one snapshot, read again by its paths."""
    what = F.struct(F.col("event_type").alias("type"), F.col("value"))
    value = details.snapshot(what=what, user=F.col("user_id"), at=details.iso_time(F.col("ts")), props=details.parsed(F.col("props")), tags=F.array("event_type", F.lit(None).cast("string")), none=F.lit(None).cast("string"))
    found = _table(spark, sf_dir, "events").select("event_id", value.alias("v"))
    at = lambda path, kind: details.detail(F.col("v"), path, kind)
    return found.select("event_id", details.canonical(F.col("v")).alias("text"), at("$.props.k", "long").alias("k"), at("$.what.type", "string").alias("type"), at("$.tags[0]", "string").alias("tag"), at("$.what.type", "int").alias("odd"))


def ordered_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of one log, newest first by kind: each with its number in the whole log."""
    lines = log_lines(spark, sf_dir).join(_table(spark, sf_dir, "events").select("event_id", "event_type", "ts"), "event_id")
    return ordered_log_ops.numbered(lines, "event_type", "ts", "event_id").select("event_id", "line_no", "line")


def log_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same log as text files, read again one after another: how many lines and which bytes each part has."""
    path = shared_path(spark, "log-text")
    lines = log_lines(spark, sf_dir).join(_table(spark, sf_dir, "events").select("event_id", "event_type", "ts"), "event_id")
    ordered_log_ops.write_log(lines, F.col("line"), path, "event_type", "ts", "event_id")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("part"), F.col("content").cast("string").alias("text"))


def collector_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rounds of users' pages: each shows one paragraph with the event's kind and hour."""
    schema = _table(spark, sf_dir, "events").schema
    # a stream takes a folder, or a pattern: this one is met by a file as by a folder of part files
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    block = F.to_json(F.array(F.struct(F.lit("paragraph").alias("type"), F.concat_ws(" ", "event_type", F.hour("ts")).alias("text"))))
    rounds = stream.select(F.col("user_id").alias("page_id"), F.col("event_id").alias("round"), block.alias("blocks"), F.lit(True).alias("moved"), F.lit(0.0).alias("scroll_top"), F.lit(0.0).alias("max_scroll_top"))
    out, marks = shared_path(spark, "collected"), shared_path(spark, "collector")
    query = collect(rounds, Policy()).writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    states = spark.read.schema("page_id long, rounds int, n_blocks int, idle int, status string, blocks string").parquet(out)
    last = states.groupBy("page_id").agg(F.max_by(F.struct("rounds", "n_blocks", "idle", "status"), "rounds").alias("s"))
    return last.select("page_id", "s.rounds", "s.n_blocks", "s.idle", "s.status")


#: Pages end by these policies: the families', with limits of rounds that the table's pages can reach.
_POLICIES = page_collector.policies(wechat={"most_rounds": 60}, scys_article={"most_rounds": 50, "stable_rounds": 3}, scys={"stable_rounds": 3})


def _scrolled(events: DataFrame) -> DataFrame:
    """Events as rounds of users' pages of all families in turn: each shows three paragraphs, some of them new."""
    families = F.array(*[F.lit(p[0]) for p in U.POLICIES])
    texts = (F.concat_ws(" ", "event_type", F.hour("ts") % 4), F.concat_ws(" ", F.lit("what comes again:"), F.dayofmonth("ts")), F.col("event_type"))
    kinds = {"level": "int", "ordered": "boolean", "depth": "int", "source_order": "double"}
    block = lambda t: F.struct(*[(F.lit("paragraph") if f == "type" else t if f == "text" else F.lit(None)).cast(kinds.get(f, "string")).alias(f) for f in page_collector.FIELDS])
    height = F.when(F.col("event_type") == "view", 1500.0).otherwise(1000.0)
    return events.select(
        F.col("user_id").alias("page_id"), F.element_at(families, (F.col("user_id") % len(U.POLICIES) + 1).cast("int")).alias("family"), F.col("event_id").alias("round"), F.col("ts").cast("timestamp").alias("ts"), F.array(*map(block, texts)).alias("blocks"),
        (F.col("event_id") % 37 != 0).alias("moved"), F.when(F.col("event_type") == "error", 0.0).otherwise(height).alias("scroll_top"), height.alias("max_scroll_top"),
    )


def collector_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rounds of pages of all families: three ways of merging, five ways of ending, and the rounds that come late."""
    schema = _table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    out, marks = shared_path(spark, "collected"), shared_path(spark, "collector")
    name, before = page_collector.PROVIDER[0], spark.conf.get(page_collector.PROVIDER[0])
    spark.conf.set(*page_collector.PROVIDER)
    try:
        found = page_collector.collect_pages(_scrolled(stream), _POLICIES, gap=timedelta(days=2), delay="1 hour")
        query = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(name, before)
    rows = spark.read.schema(found.schema).parquet(out)
    # of a page's states the last: a timer's has the same counters and another status
    last = F.max_by(F.struct("rounds", "n_blocks", "before", "after", "removed", "idle", "late", "status"), F.struct("rounds", "late", F.col("status") != "running"))
    states = rows.where("kind = 'state'").groupBy("page_id").agg(last.alias("s"))
    late = rows.where("kind = 'late'").groupBy("page_id").agg(F.count(F.lit(1)).alias("n_late"), F.min("round").alias("first_late"))
    return states.join(late, "page_id", "left").select("page_id", "s.rounds", "s.n_blocks", "s.before", "s.after", "s.removed", "s.idle", "s.status", F.coalesce("n_late", F.lit(0)).alias("n_late"), "first_late")


def doc_plain_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each text as items with a dot, blank lines between them, written as one list."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda line: F.trim(line) != "")
    text = F.array_join(F.transform(lines, lambda line: F.concat(F.lit(chr(0x2022) + " "), line)), "\n\n")
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(plain_lists(text)).alias("list_md5"), F.size(lines).alias("n_lines"))


def _as_html(text: Column) -> Column:
    out = text
    for mark, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(mark), F.lit(code))
    return out


def _family_html(head: str, tail: str, forms: tuple[str, ...]) -> Column:
    """A document as a page, whose lines take turns in the forms of a family's blocks: %n is a line's number, %s its text."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")

    def block(line: Column, i: Column) -> Column:
        form = F.element_at(F.array(*map(F.lit, forms)), (i % len(forms) + 1).cast("int"))
        return F.replace(F.replace(form, F.lit("%n"), (i + 1).cast("string")), F.lit("%s"), _as_html(line))

    return F.concat(F.lit(head), F.array_join(F.transform(lines, block), ""), F.lit(tail))


def _family_pages(spark: SparkSession, sf_dir: str, url: str, head: str, tail: str, forms: tuple[str, ...]) -> DataFrame:
    """A page for each document."""
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.lit(url).alias("url"), _family_html(head, tail, forms).alias("html"))


#: A generic page's kinds of blocks, in turn.
_RICH = (
    "<h3>%s</h3>", "<p>%s</p>", "<ul><li>%s</li></ul>", "<blockquote>%s</blockquote>", "<pre>%s</pre>", '<img src="/i/%n.png" alt="%s">', '<video src="v/%n.mp4" title="Clip %n"></video>', '<a href="?n=%n">%s</a>',
)


def _rich_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _family_pages(spark, sf_dir, "https://www.example.com/docs/page", "<html><body><nav><a href=x>menu</a></nav><article>", '<p style="display: none">unseen</p></article></body></html>', _RICH)
    return B.page_areas(pages)


def rich_page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages with blocks of all kinds that a generic page may have."""
    found = _rich_areas(spark, sf_dir).select("page_id", F.posexplode("blocks").alias("at", "b"))
    return found.select("page_id", (F.col("at") + 1).alias("pos"), "b.*")


def rich_page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = lambda b: _struct(type=b["type"], text=b["text"], level=b["level"], src=b["src"], alt=b["alt"], href=b["href"])
    areas = _rich_areas(spark, sf_dir).where("blocks is not null")
    made = document_markdown(F.lit("Rich page"), F.col("url"), X.captured_at(F.lit(CAPTURED).cast("timestamp")), F.transform("blocks", block))
    return areas.select("page_id", F.md5(made).alias("markdown_md5"), F.length(made).alias("n_chars"))


def _media_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a page with pictures and a video, some at addresses that are refused."""
    d = F.col("doc_id").cast("string")
    sources = (F.concat(F.lit("/m/"), d, F.lit(".png")), F.lit("http://10.0.0.1/x.png"), F.lit("ftp://e.com/a.png"), F.concat(F.lit("/m/"), d, F.lit(".gif")), F.concat(F.lit("m/"), d, F.lit(".png?again")))
    pictures = [_struct(type=F.lit("image"), src=src, alt=F.col("source")) for src in sources]
    blocks = F.array(_struct(type=F.lit("paragraph"), text=F.col("text")), *pictures, _struct(type=F.lit("video"), src=F.concat(F.lit("/m/"), d, F.lit(".mp4")), text=F.lit("Clip")))
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.lit("https://m.example.com/p").alias("url"), F.concat(F.lit("Doc "), d).alias("title"), blocks.alias("blocks"))


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was answered for each document's media: files that start as they should or don't, errors and other types."""
    n = F.col("doc_id")
    text = F.coalesce("text", F.lit("")).cast("binary")
    made = lambda end, kind, start: F.struct(F.lit(end).alias("end"), kind.alias("content_type"), F.concat(F.unhex(start), text).alias("data"))
    files = F.array(
        made(".png", F.lit("image/png"), F.lit("89504E470D0A1A0A")),
        made(".gif", F.when(n % 4 == 0, F.lit("text/html")).otherwise(F.lit("Image/GIF; q=1")), F.when(n % 3 == 0, F.lit("00")).otherwise(F.lit("474946383961"))),
        made(".mp4", F.lit("video/mp4; codecs=x"), F.when(n % 7 == 0, F.lit("00")).otherwise(F.lit("00000018667479706D703432"))),
    )
    rows = _table(spark, sf_dir, "documents").select(n, F.explode(files).alias("f"))
    return rows.select(F.concat(F.lit("https://m.example.com/m/"), n.cast("string"), "f.end").alias("url"), F.when(n % 5 == 0, 404).otherwise(200).alias("status"), "f.content_type", "f.data")


def media_localized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each picture and video: refused, not answered, not what it should be, or a file of the export."""
    found = media_ops.localize(media_ops.media_list(_media_documents(spark, sf_dir)), _responses(spark, sf_dir))
    return found.select("page_id", "kind", "idx", "src", "ok", "reason", "file_name", F.md5("data").alias("data_md5"))


def _blob_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a page whose pictures are blobs, one of them with the text as its data, data in their addresses, and a
    video."""
    d = F.col("doc_id").cast("string")
    data = F.base64(F.concat(F.unhex(F.lit("474946383961")), F.col("source").cast("binary")))
    urls = [F.concat(F.lit(f" blob:https://b.example.com/{kind}-"), d) for kind in ("png", "odd", "html", "none")]
    pictures = [_struct(type=F.lit("image"), src=u, alt=F.col("source")) for u in urls]
    own = _struct(type=F.lit("image"), src=F.lit("data:x"), embedded_data_url=F.concat(F.when(F.col("doc_id") % 4 == 0, "data:image/bmp").otherwise("data:image/gif"), F.lit(";base64,"), data))
    blocks = F.array(_struct(type=F.lit("paragraph"), text=F.col("source")), *pictures, own, _struct(type=F.lit("video"), src=F.concat(F.lit("blob:https://b.example.com/v-"), d), text=F.lit("Clip")))
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.lit("https://b.example.com/p").alias("url"), blocks.alias("blocks"))
    made = lambda name, kind, start, of: F.struct(F.lit(name).alias("name"), F.lit(kind).alias("content_type"), F.concat(F.unhex(F.lit(start)), F.coalesce(of, F.lit("")).cast("binary")).alias("data"))
    answers = F.array(made("png", "Image/PNG; q=1", "89504E470D0A1A0A", F.col("text")), made("odd", "image/jpeg", "00", F.col("source")), made("html", "text/html", "89504E470D0A1A0A", F.col("source")))
    blobs = _table(spark, sf_dir, "documents").select(d.alias("d"), "doc_id", F.explode(answers).alias("a"))
    blobs = blobs.select(F.concat(F.lit("blob:https://b.example.com/"), "a.name", F.lit("-"), "d").alias("url"), F.when(F.col("doc_id") % 5 == 0, 404).otherwise(200).alias("status"), "a.content_type", "a.data")
    return export.embed_blobs(docs, blobs)


def _blob_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_ops.localize(media_ops.media_list(_blob_documents(spark, sf_dir)), _responses(spark, sf_dir))


def blob_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of pictures that are blobs or whose addresses hold them."""
    return _blob_media(spark, sf_dir).select("page_id", "kind", "idx", "ok", "reason", "file_name", F.md5("data").alias("data_md5"))


def media_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pictures and videos there are, were localised and failed, counted while their rows are written."""
    localized, metrics = media_ops.observed(_blob_media(spark, sf_dir))
    localized.write.parquet(shared_path(spark, "localized"))
    found = metrics.get
    rows = [(k, *(int(found[f"{k}_{what}"]) for what in ("total", "success", "failed"))) for k in ("image", "video")]
    return spark.createDataFrame(rows, "kind string, total long, success long, failed long")


def export_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive for each document's page with its Markdown, whose media have local addresses, and the media."""
    entries = export.export_entries(_media_documents(spark, sf_dir), _responses(spark, sf_dir), F.lit(CAPTURED).cast("timestamp"))
    packed = zip_sink.zip_archives(entries, "page_id")
    return packed.select("page_id", "n_entries", "n_bytes", F.sha2("bytes", 256).alias("bytes_sha256"))


def feishu_page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = '<div class="zone-container" data-slate-editor="true"><div class="ace-line">%s</div></div>'
    forms = tuple(f'<div class="block docx-{kind}-block" data-block-id="%n">{line}</div>' for kind in ("text", "bullet", "heading2", "ordered"))
    pages = _family_pages(spark, sf_dir, "https://a.feishu.cn/docx/1", '<div class="block docx-page-block" data-block-id="0">', "</div>", forms)
    return feishu.feishu_blocks(pages).select("page_id", "pos", "type", "level", "text", "markdown", "ordered", "depth", "source_id")


def course_page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = '<div class="vc-doc-item %k">%b</div>'
    forms = tuple(
        item.replace("%k", kind).replace("%b", body)
        for kind, body in (("", '<div class="block-text">%s</div>'), ("", '<div class="bullet_container"><div class="bulletlist">%s</div></div>'), ("doc-heading-3", '<div class="block-text">%s</div>'), ("", '<div class="quote_container">%s</div>'))
    )
    pages = _family_pages(spark, sf_dir, "https://scys.com/course/detail/1", '<main><div class="feishu-doc-content">', "</div></main>", forms)
    return course.course_blocks(pages).select("page_id", "pos", "type", "level", "text", "markdown", "ordered", "depth")


def article_page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as long articles, whose items are paragraphs, list items, headings and quotes in turn."""
    item = '<div class="vc-doc-item %k">%b</div>'
    forms = tuple(
        item.replace("%k", kind).replace("%b", body)
        for kind, body in (("", '<div class="block-text">%s</div>'), ("", '<div class="bullet_container"><div class="bulletlist">%s</div></div>'), ("doc-heading-3", '<div class="block-text">%s</div>'), ("", '<div class="quote_container"><div class="block-text">%s</div></div>'))
    )
    pages = _family_pages(spark, sf_dir, "https://scys.com/articleDetail/xq_topic/1", '<main><div class="feishu-doc-content">', "</div></main>", forms)
    return article.article_blocks(pages).select("page_id", "pos", "type", "level", "text", "markdown", "ordered", "depth")


def _account_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = ("<p>%s</p>", "<h2>%s</h2>", "<p> %s <br></p>", '<p><img data-src="https://mmbiz.qpic.cn/%n?wx_fmt=png&amp;tp=webp" alt="%s"></p>')
    return _family_pages(spark, sf_dir, "https://mp.weixin.qq.com/s/1", '<div id="js_content">', '<p style="display:none">unseen</p></div>', forms)


def wechat_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the text of documents as public-account pages their blocks have."""
    return wechat.page_coverage(_account_pages(spark, sf_dir))


def wechat_page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as public-account pages: paragraphs, headings and pictures, which part the text."""
    return wechat.wechat_blocks(_account_pages(spark, sf_dir)).select("page_id", "pos", "type", F.md5("markdown").alias("markdown_md5"), "src", "alt", "source_id")


_ZONE = '<div class="zone-container" data-slate-editor="true"><div class="ace-line">%s</div></div>'
_FEISHU = (
    *(f'<div class="block docx-{kind}-block" data-block-id="%n">{_ZONE}</div>' for kind in ("text", "bullet", "heading2", "ordered")),
    '<div class="block docx-code-block" data-block-id="%n"><div class="code-block-zone-container"><div class="ace-line">%s</div></div></div>',
    '<div class="block docx-image-block" data-block-id="%n"><img src="/i/%n.png" alt="%s"></div>',
    f'<div class="block docx-table-block" data-block-id="%n"><table><tr><td class="block docx-table_cell-block" data-block-id="c%n"><div class="block docx-text-block" data-block-id="t%n">{_ZONE}</div></td><td>n %n</td></tr></table></div>',
    f'<div class="block docx-quote_container-block" data-block-id="%n"><div class="block docx-text-block" data-block-id="q%n">{_ZONE}</div></div>',
)
_LISTED = '<div class="bullet_container"><div class="bulletlist">%s</div></div>'
_ITEMS = (
    '<div class="vc-doc-item"><div class="block-text">%s</div></div>',
    f'<div class="vc-doc-item">{_LISTED}</div>',
    '<div class="vc-doc-item doc-heading-3"><div class="block-text">%s</div></div>',
    '<div class="vc-doc-item"><div class="quote_container"><div class="block-text">%s</div></div></div>',
    '<div class="vc-doc-item"><div class="block-code-language">Plain Text</div><div class="block-code-content">  %s</div></div>',
    '<div class="vc-doc-item"><div class="table table_2"><div class="table_cell">%s</div><div class="table_cell">n %n</div><div class="table_cell">x</div></div></div>',
    f'<div class="vc-doc-item">{_LISTED}<div class="vc-doc-item">{_LISTED.replace("%s", "in %s")}</div></div>',
)
_VIDEO = '<div class="vc-doc-item"><div class="block-file video"><div class="title">%s</div><video class="video-preview" src="https://v.example.com/%n.mp4"></video></div></div>'
_PICTURED = '<div class="vc-doc-item"><div class="block-text">%s</div><img src="/i/%n.png" alt="%s"></div>'
_ACCOUNT = ("<p>%s</p>", "<h2>%s</h2>", "<p> %s <br></p>", '<p><img data-src="https://mmbiz.qpic.cn/%n?wx_fmt=png&amp;tp=webp" alt="%s"></p>')


def _site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of all families in turn, and as pages that a family's address names but that lack its root: with
    nested lists, tables, grids, code, pictures and videos."""
    generic = '<html><head>%t</head><body><nav><a href=x>menu</a></nav><article>', "</article></body></html>"
    sites = (
        ("https://mp.weixin.qq.com/s/1", '<h1 id="activity-name"> Account  page </h1><div id="js_content">', '<p style="display:none">unseen</p></div>', _ACCOUNT),
        ("https://scys.com/articleDetail/xq_topic/1", '<main><h1>abc</h1><h1 class="topic-title">A topic</h1><div class="feishu-doc-content">', "</div></main>", (*_ITEMS, _PICTURED)),
        ("https://scys.com/course/detail/1", '<title>Site</title><main><h1>Course</h1><div class="feishu-doc-content">', "</div></main>", (*_ITEMS, _VIDEO)),
        ("https://a.feishu.cn/docx/1", '<title>Doc &amp; more</title><div class="block docx-page-block" data-block-id="0">', "</div>", _FEISHU),
        ("https://www.example.com/docs/page", generic[0].replace("%t", "<title> Rich  page</title>"), generic[1], _RICH),
        ("https://scys.com/course/detail/1", generic[0].replace("%t", ""), generic[1], _RICH),
    )
    which, url, html = F.col("doc_id") % len(sites), F.lit(None).cast("string"), F.lit(None).cast("string")
    for n, (address, head, tail, forms) in enumerate(sites):
        url, html = F.when(which == n, F.lit(address)).otherwise(url), F.when(which == n, _family_html(head, tail, forms)).otherwise(html)
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), url.alias("url"), html.alias("html"))


def mixed_site_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages of a mixed table, each parsed once and read by its site's reader. The text of public-account pages is made
    of their Markdown, which is what is compared."""
    found = dispatch.read_pages(_site_pages(spark, sf_dir))
    text = F.when(F.col("family") != "wechat", F.col("text"))
    return found.select("page_id", "family", "pos", "type", "level", text.alias("text"), "markdown", "ordered", "depth", "language", "src", "alt", "href", F.to_json("rows").alias("rows"), "source_id")


def mixed_site_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title of each page of a mixed table, and who reads it."""
    return dispatch.parse(_site_pages(spark, sf_dir)).titles()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        page_blocks, page_blocks_lateral, page_scores, page_type_counts, page_markdown, page_export_names, page_links, site_family_dispatch, media_url_safety, log_safe_url, doc_normalized, doc_lines_dedupe,
        doc_filename, line_overlap_merge, fragment_merge, ordered_snapshot_merge, list_islands, table_render, cell_chunking, image_signature, fifo_media_rewrite, zip_offsets, zip_path_safety,
        crc32_entries, zip_archives, feishu_page_blocks, course_page_blocks, doc_plain_lists, coverage_diagnostics, log_lines, collector_stream, rich_page_blocks, rich_page_markdown,
        media_localized, export_archives, article_page_blocks, wechat_page_blocks, wechat_coverage, mixed_site_blocks, mixed_site_titles,
        collector_policies, archive_files, blob_images, media_metrics, promoted_areas, ordered_log, log_text, event_details,
    )
}
# the names under which the queries over whole texts were registered first
QUERIES |= {"line_overlap_merge_whole": line_overlap_merge, "table_render_whole": table_render}
