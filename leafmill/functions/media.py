"""Media: file names, what the bytes are, and whether a response can be used."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds by content type and by extension of an address.
KIND_OF_TYPE = {"image/jpeg": "jpeg", "image/jpg": "jpeg", "image/png": "png", "image/gif": "gif", "image/webp": "webp", "image/avif": "avif"}
KIND_OF_EXTENSION = {".jpg": "jpeg", ".png": "png", ".gif": "gif", ".webp": "webp", ".avif": "avif"}
EXTENSION_OF_TYPE = {"image/jpeg": ".jpg", "image/jpg": ".jpg", "image/png": ".png", "image/gif": ".gif", "image/webp": ".webp", "image/svg+xml": ".svg", "image/avif": ".avif"}
SAFE_EXTENSIONS = ("jpg", "png", "gif", "webp", "svg", "avif", "img")
URL_EXTENSIONS = ("png", "jpg", "jpeg", "gif", "webp", "svg", "avif")
VIDEO_TYPES = ("", "video/mp4", "application/mp4", "application/octet-stream")
# Why a response can't be used, and the form of an embedded image.
NOT_FOUND, STATUS, IMAGE_TYPE, IMAGE_EXTENSION = "not found", "status=", "unsupported image type=", "unsupported binary image extension="
CONTENT_TYPE, IMAGE_SIGNATURE, VIDEO_SIGNATURE, EMBEDDED = "unexpected content-type=", "image signature mismatch expected=", "video signature mismatch expected=mp4", "invalid embedded image data"
DATA_URL = r"^data:([^;,]+);base64,([a-zA-Z0-9+/=\s]+)$"
INLINE_SVG = r"(?i)^\s*data:image/svg\+xml(?:[;,]|\s*$)"


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(""))


def content_type(header: Column) -> Column:
    return F.lower(F.trim(F.split_part(F.coalesce(header, F.lit("")), F.lit(";"), F.lit(1))))


def extension_of_type(header: Column) -> Column:
    return _lookup(EXTENSION_OF_TYPE, content_type(header))


def extension_of_url(url: Column) -> Column:
    """.png and the like from the last part of the path; empty for others."""
    path = F.regexp_replace(F.coalesce(url, F.lit("")), r"[?#].*$", "")
    found = F.lower(F.regexp_extract(path, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*/(?:[^/]*/)*[^/]*\.([^./]+)$", 1))
    return F.when(found == "jpeg", ".jpg").when(found.isin(*URL_EXTENSIONS), F.concat(F.lit("."), found)).otherwise(F.lit(""))


def safe_extension(extension: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(extension, F.lit(""))))
    bare = F.regexp_replace(low, r"^\.", "")
    good = low.rlike(r"^\.?[a-z0-9]+$") & ~F.coalesce(extension, F.lit("")).rlike(r"[\x{0}-\x{1f}\x{7f}]")
    return F.when(good & (bare == "jpeg"), ".jpg").when(good & bare.isin(*SAFE_EXTENSIONS), F.concat(F.lit("."), bare)).otherwise(F.lit(".img"))


def image_name(index: Column, extension: Column) -> Column:
    """image-001.png and so on; index from 0."""
    return F.concat(F.format_string("image-%03d", (index + 1).cast("long")), safe_extension(extension))


def video_name(index: Column) -> Column:
    return F.format_string("video-%03d.mp4", (index + 1).cast("long"))


def _bytes_at(data: Column, at: int, wanted: str) -> Column:
    return F.hex(F.substring(data, at + 1, len(wanted) // 2)) == wanted


def matches(kind: Column, data: Column) -> Column:
    """Whether the bytes start as files of the kind do."""
    steps = F.when(F.octet_length(data) >= 12, F.sequence(F.lit(9), F.octet_length(data) - 3, F.lit(4))).otherwise(F.array().cast("array<int>"))
    brand = F.exists(steps, lambda i: F.hex(F.substring(data, i, F.lit(4))).isin("61766966", "61766973"))
    is_kind = (
        F.when(kind == "jpeg", _bytes_at(data, 0, "FFD8FF"))
        .when(kind == "png", _bytes_at(data, 0, "89504E470D0A1A0A"))
        .when(kind == "gif", _bytes_at(data, 0, "474946383761") | _bytes_at(data, 0, "474946383961"))
        .when(kind == "webp", _bytes_at(data, 0, "52494646") & _bytes_at(data, 8, "57454250"))
        .when(kind == "avif", _bytes_at(data, 4, "66747970") & brand)
        .when(kind == "mp4", _bytes_at(data, 4, "66747970") & (F.octet_length(data) >= 12))
    )
    return F.coalesce(is_kind, F.lit(False))


def image_verdict(status: Column, header: Column, url: Column, data: Column) -> Column:
    """ok, reason and extension of a response to an image request."""
    kind_name, by_url = content_type(header), extension_of_url(url)
    is_image = kind_name.startswith("image/")
    untyped = kind_name.isin("", "application/octet-stream")
    kind = F.when(is_image, _lookup(KIND_OF_TYPE, kind_name)).when(untyped, _lookup(KIND_OF_EXTENSION, by_url)).otherwise(F.lit(""))
    reason = (
        F.when(status.isNull(), NOT_FOUND)
        .when(~status.between(200, 299), F.concat(F.lit(STATUS), status.cast("string")))
        .when(is_image & (kind == ""), F.concat(F.lit(IMAGE_TYPE), kind_name))
        .when(untyped & (kind == ""), F.concat(F.lit(IMAGE_EXTENSION), F.coalesce(F.nullif(by_url, F.lit("")), F.lit("none"))))
        .when(~is_image & ~untyped, F.concat(F.lit(CONTENT_TYPE), kind_name))
        .when(~matches(kind, data), F.concat(F.lit(IMAGE_SIGNATURE), kind))
    )
    extension = F.when(kind == "jpeg", ".jpg").otherwise(F.concat(F.lit("."), kind))
    return F.struct(reason.isNull().alias("ok"), reason.alias("reason"), F.when(reason.isNull(), extension).alias("extension"))


def video_verdict(status: Column, header: Column, data: Column) -> Column:
    kind_name = content_type(header)
    reason = (
        F.when(status.isNull(), NOT_FOUND)
        .when(~status.between(200, 299), F.concat(F.lit(STATUS), status.cast("string")))
        .when(~kind_name.isin(*VIDEO_TYPES), F.concat(F.lit(CONTENT_TYPE), kind_name))
        .when(~matches(F.lit("mp4"), data), F.lit(VIDEO_SIGNATURE))
    )
    return F.struct(reason.isNull().alias("ok"), reason.alias("reason"), F.when(reason.isNull(), ".mp4").alias("extension"))


def embedded_image(data_url: Column) -> Column:
    """ok, reason, extension and data of an image that its address holds."""
    kind_name = F.lower(F.trim(F.regexp_extract(F.coalesce(data_url, F.lit("")), DATA_URL, 1)))
    kind = _lookup(KIND_OF_TYPE, kind_name)
    data = F.try_to_binary(F.regexp_replace(F.regexp_extract(F.coalesce(data_url, F.lit("")), DATA_URL, 2), r"\s", ""), F.lit("base64"))
    reason = (
        F.when(~F.coalesce(data_url, F.lit("")).rlike(DATA_URL) | data.isNull(), EMBEDDED)
        .when(~kind_name.startswith("image/"), F.concat(F.lit(CONTENT_TYPE), kind_name))
        .when(kind == "", F.concat(F.lit(IMAGE_TYPE), kind_name))
        .when(~matches(kind, data), F.concat(F.lit(IMAGE_SIGNATURE), kind))
    )
    return F.struct(
        reason.isNull().alias("ok"), reason.alias("reason"), F.when(reason.isNull(), F.when(kind == "jpeg", ".jpg").otherwise(F.concat(F.lit("."), kind))).alias("extension"), F.when(reason.isNull(), data).alias("data")
    )


def without_inline_svg(blocks: Column) -> Column:
    """Blocks without inline SVG pictures, in tables too."""
    kept = F.filter(blocks, lambda b: ~((b["type"] == "image") & F.coalesce(b["src"], F.lit("")).rlike(INLINE_SVG)))
    return F.transform(kept, lambda b: b.withField("images", F.filter(b["images"], lambda i: ~F.coalesce(i["src"], F.lit("")).rlike(INLINE_SVG))))


def has_content(blocks: Column) -> Column:
    """Whether there is anything to export."""
    text = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    shows = lambda b: (
        F.when(b["type"].isin("image", "video"), F.coalesce(b["src"], F.lit("")) != "")
        .when(b["type"] == "link", (F.coalesce(b["href"], F.lit("")) != "") | text(b["text"]))
        .when(b["type"] == "table", F.exists(F.flatten(b["rows"]), text) | F.exists(b["images"], lambda i: F.coalesce(i["src"], F.lit("")) != ""))
        .otherwise(text(b["text"]))
    )
    return F.coalesce(F.exists(blocks, lambda b: F.coalesce(shows(b), F.lit(False))), F.lit(False))
