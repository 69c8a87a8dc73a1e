"""Media of documents: which there are, what became of their requests, and the addresses they get."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import media as M
from ..functions.urls import media_request


def media_list(documents: DataFrame, page: str = "page_id") -> DataFrame:
    """page, url, kind, idx (from 0 in its kind), src, embedded: pictures of blocks and tables, and videos, in document order.

    documents has page, url and blocks."""
    none = F.array().cast("array<struct<kind:string,src:string,embedded:string>>")
    item = lambda kind, x, embedded: F.struct(F.lit(kind).alias("kind"), x["src"].alias("src"), embedded.alias("embedded"))
    of_block = lambda b: (
        F.when(b["type"].isin("image", "video"), F.array(F.struct(b["type"].alias("kind"), b["src"].alias("src"), b["embedded_data_url"].alias("embedded"))))
        .when(b["type"] == "table", F.transform(F.coalesce(b["images"], F.array()), lambda i: item("image", i, F.lit(None).cast("string"))))
        .otherwise(none)
    )
    found = F.filter(F.flatten(F.transform("blocks", of_block)), lambda m: F.coalesce(m["src"], F.lit("")) != "")
    rows = documents.select(page, "url", F.posexplode(found).alias("at", "m")).select(page, "url", "at", "m.*")
    return rows.withColumn("idx", F.row_number().over(Window.partitionBy(page, "kind").orderBy("at")) - 1).drop("at")


def localize(media: DataFrame, assets: DataFrame, page: str = "page_id") -> DataFrame:
    """media with ok, reason, file_name and data: what a table of responses (url, status, content_type, data) holds for it.

    Refused addresses are not looked up. A response is joined by its address, so bytes move once to where they are used.
    """
    asked = media.withColumn("request", F.when(F.col("embedded").isNull(), media_request(F.col("src"), F.col("url"))))
    answers = assets.select(F.col("url").alias("asset_url"), "status", "content_type", "data")
    got = asked.join(answers, F.col("request.ok") & (F.col("request.href") == F.col("asset_url")), "left")
    own = M.embedded_image(F.col("embedded"))
    image = M.image_verdict(F.col("status"), F.col("content_type"), F.col("request.href"), F.col("data"))
    video = M.video_verdict(F.col("status"), F.col("content_type"), F.col("data"))
    why = F.when(F.col("kind") == "video", F.replace("request.reason", F.lit("unsafe image URL"), F.lit("unsafe video URL"))).otherwise(F.col("request.reason"))
    refused = F.struct(F.lit(False).alias("ok"), why.alias("reason"), F.lit(None).cast("string").alias("extension"))
    verdict = F.when(F.col("embedded").isNotNull(), F.struct(own["ok"].alias("ok"), own["reason"].alias("reason"), own["extension"].alias("extension"))).when(~F.col("request.ok"), refused).when(F.col("kind") == "video", video).otherwise(image)
    name = F.when(F.col("kind") == "video", M.video_name(F.col("idx"))).otherwise(M.image_name(F.col("idx"), F.col("verdict.extension")))
    return got.withColumn("verdict", verdict).select(
        page, "kind", "idx", "src", F.col("verdict.ok").alias("ok"), F.col("verdict.reason").alias("reason"), F.when(F.col("verdict.ok"), name).alias("file_name"), F.when(F.col("verdict.ok"), F.coalesce(own["data"], F.col("data"))).alias("data")
    )


def observed(localized: DataFrame, name: str = "media") -> tuple[DataFrame, Observation]:
    """localized, and how many pictures and videos there are, were localised and failed: counted by the job that uses the rows
    first, as they pass. A job that is never run leaves no counts."""
    metrics = Observation(name)
    of = lambda kind: F.col("kind") == kind
    counts = [F.count_if(of(k) & test).alias(f"{k}_{what}") for k in ("image", "video") for what, test in (("total", F.lit(True)), ("success", F.col("ok").eqNullSafe(True)), ("failed", ~F.col("ok").eqNullSafe(True)))]
    return localized.observe(metrics, *counts), metrics


def rewrite(uses: DataFrame, localized: DataFrame, order: str, page: str = "page_id", src: str = "src") -> DataFrame:
    """uses with local: the k-th use of an address on a page gets the k-th result for it, in the order of idx; else null.

    localized has page, src, idx, ok and file_name."""
    nth = F.row_number().over(Window.partitionBy(page, src).orderBy(order))
    results = localized.select(F.col(page).alias("_page"), F.col("src").alias("_src"), F.row_number().over(Window.partitionBy(page, "src").orderBy("idx")).alias("_nth"), F.when(F.col("ok"), F.col("file_name")).alias("local"))
    counted = uses.withColumn("nth", nth)
    return counted.join(results, (F.col(page) == F.col("_page")) & (F.col(src) == F.col("_src")) & (F.col("nth") == F.col("_nth")), "left").drop("_page", "_src", "_nth")
