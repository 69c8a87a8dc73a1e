from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from leafmill.functions import media as M
from leafmill.functions import text as X
from leafmill.functions import urls as U
from leafmill.functions.markdown import BLOCK, IMAGE, block_markdown, document_markdown, table_markdown

ESC = chr(92)


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values()) or (0,)], ", ".join(f"{k} {'binary' if isinstance(v, bytes) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items()) or "zero int")
    return df.select(column.alias("r")).first().r


NBSP, ZWSP, EMOJI = chr(0xA0), chr(0x200B), chr(0x1F600)


@pytest.mark.parametrize(
    "made, text, want",
    [
        (X.normalize_text, f"{NBSP}a  b{ZWSP} c\n", "a b c"),
        (X.normalize_text, "a\x0cb", "ab"),
        (X.normalize_text, None, ""),
        (X.title_name, "a\x0cb", "a b"),
        (X.title_name, '--A/B: "C"?', "A-B- -C"),
        (X.title_name, "", "web-clip"),
        (X.title_name, "x" * 79 + " - y", "x" * 79),
        (X.file_name, None, "web-clip"),
        (X.file_name, "a/b:c", "a-b-c"),
        (X.list_depth, "2.9", 2),
        (X.list_depth, "-1", 0),
        (X.list_depth, "x", 0),
        (X.escape_label, f"a[b]{ESC}", f"a{ESC}[b{ESC}]{ESC}{ESC}"),
        (X.escape_url, "h x(1)", "h%20x%281%29"),
        (X.utf16_length, EMOJI + "a", 3),
        (X.code_language, "Plain Text", "text"),
        (X.code_language, "md", "markdown"),
        (X.normalize_code, "\r\n a\r\nb \n", "a\nb"),
        (X.normalize_indented_code, "\n  a  \r\n\tb\r\n", "  a\n\tb"),
        (X.inline_markdown_to_text, "**a** [b](c)<br>d", "a b d"),
        (X.markdown_to_text, "# T\n\n- **a** ![i](u) [l](u)\n```py\nx\n```", "T a i l x"),
        (X.table_cell, "b|c\nd", f"b{ESC}|c<br>d"),
        (M.extension_of_url, "https://h/x.JPEG?a=1", ".jpg"),
        (M.extension_of_url, "https://h/x.bmp", ""),
        (M.extension_of_url, "nope", ""),
        (M.extension_of_type, "Image/PNG; q=1", ".png"),
        (M.safe_extension, "bmp", ".img"),
        (M.safe_extension, ".JPEG", ".jpg"),
        (U.log_safe, "https://h/p?q#f", "https://h/p"),
        (U.log_safe, "x", "invalid-url"),
        (U.site_family, "https://mp.weixin.qq.com/s/x", "wechat"),
        (U.site_family, "https://www.scys.com/articleDetail/xq_topic/1", "scys-article"),
        (U.site_family, "https://scys.com/course/detail/1/", "scys"),
        (U.site_family, "https://a.feishu.cn./docx/1", "feishu"),
        (U.site_family, "https://notfeishu.cn/docx/1", "generic"),
    ],
)
def test_scalars(spark, made, text, want):
    assert one(spark, made(F.col("v")), v=text) == want


def test_wrap_inline(spark):
    assert one(spark, X.wrap_inline(F.col("v"), "**"), v=" a b ") == " **a b** "
    assert one(spark, X.wrap_inline(F.col("v"), "**"), v="  ") == "  "


def test_overlap(spark):
    merge = X.overlap_merge(F.col("a"), F.col("b"))
    assert one(spark, merge, a="0123 abcdefghijkl", b="abcdefghijkl 99") == "0123 abcdefghijkl 99"
    assert one(spark, merge, a="xx abc", b="abc yy") is None


def test_names(spark):
    assert one(spark, M.image_name(F.col("i"), F.col("e")), i=0, e=".png") == "image-001.png"
    assert one(spark, M.image_name(F.col("i"), F.col("e")), i=11, e="bmp") == "image-012.img"
    assert one(spark, M.image_name(F.col("i"), F.col("e")), i=1233, e="gif") == "image-1234.gif"
    assert one(spark, M.video_name(F.col("i")), i=0) == "video-001.mp4"


def table(spark, rows, images=()):
    df = spark.createDataFrame([(rows, [(*i, None) for i in images])], f"r array<array<string>>, i array<{IMAGE}>")
    return df.select(table_markdown(F.col("r"), F.col("i"))).first()[0]


def test_table(spark):
    assert table(spark, [["a"], ["b|c", "d\ne"]]) == f"| a |  |\n| --- | --- |\n| b{ESC}|c | d<br>e |"
    assert table(spark, []) == ""
    assert table(spark, [[], ["a"]], [("u v", "x|y", 0, 2), ("u", None, 0, 0), ("u", None, 5, 0)]) == f"| a<br>![](u) |  | ![x{ESC}|y](u%20v) |\n| --- | --- | --- |"


def render(spark, **fields):
    names = {"type": "string", "text": "string", "markdown": "string", "level": "int", "ordered": "boolean", "depth": "int", "language": "string", "src": "string", "alt": "string", "href": "string"}
    df = spark.createDataFrame([tuple(fields.get(n) for n in names)], ", ".join(f"{n} {t}" for n, t in names.items()))
    b = F.struct("*", *[F.lit(None).alias(n) for n in ("rows", "images", "embedded_data_url", "source_id", "source_order")]).cast(BLOCK)
    return df.select(b.alias("b")).select(block_markdown(F.col("b"))).first()[0]


def test_blocks(spark):
    assert render(spark, type="heading", text="A", level=0) == "## A"
    assert render(spark, type="heading", text="A", level=9) == "###### A"
    assert render(spark, type="listItem", text="x", depth=1, ordered=True) == "    1. x"
    assert render(spark, type="quote", text="a\nb") == "> a\n> b"
    assert render(spark, type="code", text="a ``` b", language="C++ x") == "````cx\na ``` b\n````"
    assert render(spark, type="code", text="") == "```\n\n```"
    assert render(spark, type="image", src="", alt="x") == ""
    assert render(spark, type="image", src="u(1)", alt="[x]") == f"![{ESC}[x{ESC}]](u%281%29)"
    assert render(spark, type="video", src="u") == "[Video](u)"
    assert render(spark, type="link", text="", href="u") == "[u](u)"
    assert render(spark, type="paragraph", text="t", markdown="**t**") == "**t**"


def test_document(spark):
    df = spark.createDataFrame([(" T ", "", "2024-01-01 00:00")], "t string, u string, c string")
    empty = F.array().cast(f"array<{BLOCK}>")
    assert df.select(document_markdown(F.col("t"), F.col("u"), F.col("c"), empty)).first()[0] == "# T\n\nCaptured: 2024-01-01 00:00\n"


PNG = bytes.fromhex("89504E470D0A1A0A00")


@pytest.mark.parametrize("kind, data, want", [
    ("png", PNG, True), ("png", PNG[:7], False), ("jpeg", b"\xff\xd8\xff", True), ("gif", b"GIF88a", False), ("gif", b"GIF89a", True), ("webp", b"RIFF0000WEBP", True),
    ("avif", b"\0\0\0\x18ftypmif1\0\0\0\0avif", True), ("avif", b"\0\0\0\x18ftypmif1\0\0\0\0av", False), ("mp4", b"\0\0\0\x18ftypisom", True), ("mp4", b"\0\0\0\x18ftyp", False), ("bmp", b"BM", False),
])
def test_signatures(spark, kind, data, want):
    assert one(spark, M.matches(F.col("k"), F.col("d")), k=kind, d=data) is want


@pytest.mark.parametrize("status, header, url, data, reason", [
    (200, "image/png", "https://h/x", PNG, None), (404, "image/png", "https://h/x", PNG, "status=404"), (200, "image/svg+xml", "https://h/x", PNG, "unsupported image type=image/svg+xml"),
    (200, "", "https://h/x.png", PNG, None), (200, "", "https://h/x", PNG, "unsupported binary image extension=none"), (200, "text/html", "https://h/x", PNG, "unexpected content-type=text/html"),
    (200, "image/jpeg", "https://h/x", PNG, "image signature mismatch expected=jpeg"),
])
def test_image_verdict(spark, status, header, url, data, reason):
    r = one(spark, M.image_verdict(F.col("s"), F.col("h"), F.col("u"), F.col("d")), s=status, h=header, u=url, d=data)
    assert (r.ok, r.reason) == (reason is None, reason)


def test_embedded(spark):
    import base64

    good = one(spark, M.embedded_image(F.col("v")), v="data:image/png;base64," + base64.b64encode(PNG).decode())
    assert good.ok and good.extension == ".png" and bytes(good.data) == PNG
    assert one(spark, M.embedded_image(F.col("v")), v="data:text/plain;base64,AAAA").reason == "unexpected content-type=text/plain"
    assert one(spark, M.embedded_image(F.col("v")), v="data:x").reason == "invalid embedded image data"


@pytest.mark.parametrize("src, why", [
    ("http://10.0.0.1/x", "local or private destination"), ("ftp://h/x", "unsupported protocol"), ("https://u:p@h.com/x", "embedded credentials"), ("https://[::1]/x", "local or private destination"),
    ("https://[fe80::1]/", "local or private destination"), ("https://[::ffff:10.1.2.3]/", "local or private destination"), ("http://0x7f.1/", "local or private destination"), ("http://2130706433/", "local or private destination"),
    ("https://a.LOCALHOST./", "local or private destination"), ("https://[2001:db8::1]/", None), ("/img/a b.png", None), ("//cdn.example.com/x", None), ("http://300.1.1.1/", "invalid URL"), ("data:image/png,xx", "unsupported protocol"),
])
def test_requests(src, why):
    ok, reason, href, credentials = U.request_of(src, "https://example.com/p/q", "image")
    assert (ok, reason) == (why is None, why and f"unsafe image URL: {why}")
    if src.startswith("/img"):
        assert (href, credentials) == ("https://example.com/img/a%20b.png", "include")
    if src.startswith("//cdn"):
        assert credentials == "omit"


def test_private_ipv4(spark):
    for host, want in (("172.16.0.1", True), ("172.32.0.1", False), ("169.254.1.1", True), ("8.8.8.8", False), ("10.0.0.256", False), ("a.b", False)):
        assert one(spark, U.private_ipv4(F.col("h")), h=host) is want


def test_effective_url(spark):
    made = U.effective_url(F.col("u"), F.col("r"))
    assert one(spark, made, u="https://scys.com/course/detail/1", r="https://www.scys.com/deepsea/a/course/b") == "https://www.scys.com/deepsea/a/course/b"
    assert one(spark, made, u="https://scys.com/course/detail/1", r="https://x.com/") == "https://scys.com/course/detail/1"


def test_log_line(spark):
    df = spark.createDataFrame([("m", "a\nb", [("k", "v\t")])], "m string, s string, d array<struct<key:string,value:string>>")
    assert df.select(X.log_line(F.col("m"), F.col("s"), F.col("d"))).first()[0] == f"[m] a{ESC}nb k=v{ESC}t"


def test_details(spark):
    """Snapshots don't depend on the order of the details; texts that are no JSON stay texts."""
    from leafmill.functions import details as D

    rows = spark.createDataFrame([('{"b": [1, {"c": null}], "a": "x"}',), ("no json",), (None,), ("",), ('"s"',)], "t string")
    p = D.parsed(F.col("t"))
    got = rows.select(D.canonical(p).alias("p"), D.canonical(D.snapshot(z=F.col("t"), a=p)).alias("v"), D.canonical(D.snapshot(a=p, z=F.col("t"))).alias("w"), D.detail(p, "$.b[1].c", "string").alias("c"), D.detail(p, "$.a", "int").alias("a")).collect()
    assert [r.p for r in got] == ['{"a":"x","b":[1,{"c":null}]}', '["no json"]', None, '[""]', '"s"']
    assert all(r.v == r.w and r.c is None and r.a is None for r in got) and got[4].v == '{"a":"s","z":"\\"s\\""}'
    errors = spark.createDataFrame([("m", "E: m"), ("", "E"), (None, "E"), (None, None)], "m string, e string").select(D.error_message(F.col("m"), F.col("e")).alias("x"))
    assert [r.x for r in errors.collect()] == ["m", "E", "E", ""]
