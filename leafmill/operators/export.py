"""Exports with their media: collect, localise, rewrite and pack.

A page's pictures and videos are numbered in document order, joined with a table of responses by their addresses, and the
blocks get the local names of those that can be used. The Markdown and the media files are the entries of one archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import media as M
from ..functions import text as X
from ..functions.markdown import document_markdown
from ..sources.shared import shared_path
from .media import localize, media_list


def embed_blobs(documents: DataFrame, blobs: DataFrame, page: str = "page_id") -> DataFrame:
    """documents whose pictures at blob: addresses have embedded_data_url, where blobs has an image for their address.

    documents: page and blocks; blobs: url, status, content_type and data, an address of which is read once, so url is unique.
    Other blocks stay as they are, as does a picture with data of its own, one that has no answer and one whose answer failed
    or is no image. page is unique. Addresses are joined by themselves; what was found goes to its page as one map, and blocks move once.
    """
    asks = lambda b: (b["type"] == "image") & F.trim(F.coalesce(b["src"], F.lit(""))).startswith("blob:") & (F.coalesce(b["embedded_data_url"], F.lit("")) == "")
    pictures = documents.select(page, F.posexplode(F.transform("blocks", lambda b: F.when(asks(b), F.trim(b["src"])))).alias("at", "blob")).where("blob is not null")
    kind = F.lower(F.trim(F.substring_index("content_type", ";", 1)))
    good = blobs.where(F.col("status").between(200, 299) & kind.startswith("image/"))
    urls = good.select(F.col("url").alias("blob"), F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.base64("data")).alias("embedded"))
    found = pictures.join(urls, "blob").groupBy(page).agg(F.map_from_entries(F.collect_list(F.struct("at", "embedded"))).alias("_embedded"))
    filled = F.transform("blocks", lambda b, at: F.when(F.map_contains_key("_embedded", at), b.withField("embedded_data_url", F.element_at("_embedded", at))).otherwise(b))
    blocks = F.when(F.col("_embedded").isNull(), F.col("blocks")).otherwise(filled).alias("blocks")
    return documents.join(found, page, "left").select(*[blocks if c == "blocks" else F.col(c) for c in documents.columns])


def _with_source(x: Column) -> Column:
    return F.coalesce(x["src"], F.lit("")) != ""


def rewritten(documents: DataFrame, localized: DataFrame, folder: str, page: str = "page_id") -> DataFrame:
    """documents whose blocks have ./folder/name for each medium that was localised, and their own addresses for the others.

    folder: the column with the name of the folder. The n-th picture of a page is the one with idx n - 1 in localized, in
    blocks and tables alike, and so for videos. A picture of a table without an address is dropped."""
    path = F.when(F.col("ok"), F.col("file_name"))
    names = localized.groupBy(page).agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("idx", path.alias("name"))))), lambda x: x["name"]).alias(k) for k in ("image", "video")])
    flat = documents.select(page, folder, F.posexplode("blocks").alias("at", "b"))
    kept = F.filter(F.col("b.images"), _with_source)
    flat = flat.withColumn("b", F.col("b").withField("images", kept))
    counts = {
        "image": F.when((F.col("b.type") == "image") & _with_source(F.col("b")), 1).when(F.col("b.type") == "table", F.coalesce(F.size("b.images"), F.lit(0))).otherwise(0),
        "video": F.when((F.col("b.type") == "video") & _with_source(F.col("b")), 1).otherwise(0),
    }
    before = Window.partitionBy(page).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    for kind, n in counts.items():
        flat = flat.withColumn(f"{kind}_at", F.coalesce(F.sum(n).over(before), F.lit(0)).cast("int"))
    flat = flat.join(names, page, "left")

    def local(kind: str, more: Column, own: Column) -> Column:
        return F.coalesce(F.concat(F.lit("./"), F.col(folder), F.lit("/"), F.get(F.col(kind), F.col(f"{kind}_at") + more)), own)

    b = F.col("b")
    src = F.when(b["type"] == "image", local("image", F.lit(0), b["src"])).when(b["type"] == "video", local("video", F.lit(0), b["src"])).otherwise(b["src"])
    images = F.when(b["type"] == "table", F.transform(b["images"], lambda i, n: i.withField("src", local("image", n, i["src"])))).otherwise(b["images"])
    flat = flat.select(page, "at", F.when(_with_source(b), b.withField("src", src)).otherwise(b).withField("images", images).alias("b"))
    blocks = flat.groupBy(page).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col("b").alias("block")))), lambda x: x["block"]).alias("blocks"))
    return documents.drop("blocks").join(blocks, page)


def export_entries(documents: DataFrame, assets: DataFrame, captured: Column, page: str = "page_id") -> DataFrame:
    """page, seq, path and data of the entries of each page's archive: the Markdown first, then the media that can be used.

    documents: page, url, title and blocks; assets: url, status, content_type and data. Inline SVG pictures are left out, and
    pages without anything to show."""
    docs = documents.withColumn("blocks", M.without_inline_svg(F.col("blocks"))).where(M.has_content(F.col("blocks")))
    docs = docs.withColumn("names", X.export_names(F.col("title"), captured)).select(page, "url", "title", "blocks", F.col("names.folder_name").alias("folder"), F.col("names.markdown_name").alias("file"), F.col("names.assets_dir").alias("assets_dir"))
    found, at = localize(media_list(docs, page), assets, page), shared_path(documents.sparkSession, "localized")
    found.write.parquet(at)  # its names and its bytes are used by themselves
    localized = documents.sparkSession.read.schema(found.schema).parquet(at)
    texts = rewritten(docs, localized.drop("data"), "assets_dir", page)
    markdown = document_markdown(F.col("title"), F.col("url"), X.captured_at(captured), F.col("blocks")).cast("binary")
    first = texts.select(page, F.lit(0).alias("seq"), F.concat_ws("/", "folder", "file").alias("path"), markdown.alias("data"))
    number = F.row_number().over(Window.partitionBy(page).orderBy("kind", "idx")).alias("seq")
    media = localized.where("ok").join(docs.select(page, "folder", "assets_dir"), page).select(page, number, F.concat_ws("/", "folder", "assets_dir", "file_name").alias("path"), "data")
    return first.unionByName(media)
