from __future__ import annotations

import io
import json
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.functions.markdown import BLOCK
from leafmill.operators import blocks as B
from leafmill.operators import islands, merge, zip_sink
from leafmill.operators import media as media_ops
from leafmill.sources.html_nodes import node_rows
from leafmill.streaming.collector import Policy, State, collect, collect_batch, step


def read(spark, html, url="https://e.com/a/b"):
    rows = B.page_blocks(spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")).orderBy("pos").collect()
    return [(r.type, r.text if r.type != "image" else r.src) for r in rows]


LONG = "word " * 40


def test_generic_rules(spark):
    html = f"""<body><nav><li>menu</li></nav><article><h1>T</h1><p>{LONG}</p><li><a href="/x">in</a></li><blockquote><p>q</p></blockquote><pre> a
  b </pre><img src="data:image/svg+xml,x" data-src="i.png" alt="p"><video src="//v.com/v.mp4" title="clip"></video>foo<br>bar<div>one <span>two</span></div><script>var p="<p>no</p>"</script><p>T</p><h1>T</h1></article></body>"""
    assert read(spark, html) == [
        ("heading", "T"), ("paragraph", LONG.strip()), ("listItem", "in"), ("link", "in"), ("quote", "q"), ("paragraph", "q"), ("code", "a\n  b"),
        ("image", "https://e.com/a/i.png"), ("video", "clip"), ("paragraph", "one two"), ("paragraph", "T"),
    ]


def test_areas(spark):
    small, big = "<p>a</p><p>b</p>", f"<p>{LONG}</p><p>x</p>"
    assert read(spark, f"<article>{small}</article><div>{big}</div>") == [("paragraph", LONG.strip()), ("paragraph", "x")]
    assert read(spark, f"<div class='content'>{big}</div><main>{big}<p>m</p></main>")[-1] == ("paragraph", "m")
    assert read(spark, "<p>short</p>") == []
    assert read(spark, None) == [] and read(spark, "") == []


def test_implied_ends():
    tags = [(r[3], r[5]) for r in node_rows("<p>a<b>x<p>b<ul><li>c<li>d</ul>e") if r[5] is not None]
    assert tags == [("p", "ax"), ("p", "b"), ("li", "c"), ("li", "d")]


def test_hidden_elements(spark):
    """What isn't displayed or seen makes no blocks and is no part of the text around it."""
    html = f"""<article><p>{LONG}</p><p hidden>a</p><p style="color: red; display :none">b</p><p>c<span style="visibility:hidden">d</span><b style="opacity: 0.0">e</b><i style="opacity:.5">f</i></p>
    <div style="visibility: hidden"><p>g</p><p style="visibility:visible">h</p></div><div style="opacity:0"><p>i</p></div><video style="display:none"><source src="/v.mp4"></video></article>"""
    assert read(spark, html)[1:] == [("paragraph", "cf"), ("paragraph", "h"), ("paragraph", "i")]


def test_addresses(spark):
    """Relative addresses count from the base element, and dots are taken out of paths."""
    page = lambda head, *srcs: f"<html><head>{head}</head><article><p>{LONG}</p>" + "".join(f"<img src='{s}'>" for s in srcs) + "</article></html>"
    assert [t for k, t in read(spark, page("", "../x.png", "./y.png", "../../../z/./w.png?a=../b", "/q/..", "http://h/a/../b")) if k == "image"] == ["https://e.com/x.png", "https://e.com/a/y.png", "https://e.com/z/w.png?a=../b", "https://e.com/", "http://h/b"]
    assert [t for k, t in read(spark, page("<base target=_top href='/m/n'>", "x.png", "//o/x")) if k == "image"] == ["https://e.com/m/x.png", "https://o/x"]


def test_deep_and_hostile_pages(spark):
    """Thousands of nested elements, in each of the parsers."""
    from leafmill.sources.html_markdown import page_markdown
    from leafmill.sources.html_marks import mark_rows

    deep = 3000
    assert len(node_rows("<div>" * deep + "x")) == deep and node_rows("<p><button>" + "<div>" * 50_000)[-1][2] == 50_001
    rows = read(spark, f"<article><p>{LONG}</p>" + "<div>" * deep + "inner" + "</div>" * deep + "</article>")
    assert rows == [("paragraph", LONG.strip()), ("paragraph", "inner")]
    assert mark_rows("<div class=a>" * 1500 + "<b>x</b>", frozenset(("a",)), True)[0][6] == "**x**"
    assert page_markdown("<div id=js_content>" + "<div>" * deep + "<b>x</b>" + "<blockquote>" * 200 + "y")[0].endswith("> y")


def test_preferences_and_repeated_blocks(spark):
    html = f"<main><div class='content'><p>{LONG}</p><p>x</p></div><h2>T</h2><p>x</p><div>only {LONG}</div></main>"
    assert read(spark, html) == [("paragraph", LONG.strip()), ("paragraph", "x"), ("heading", "T"), ("paragraph", "only " + LONG.strip())]


P = lambda text, **more: {"type": "paragraph", "text": text, **more}


@pytest.mark.parametrize("known, seen, want", [("AC", "ABC", "ABC"), ("B", "AB", "AB"), ("AB", "XY", "ABXY"), ("AB", "BXA", "ABX"), ("", "AAB", "AB"), ("AB", "", "AB")])
def test_ordered(known, seen, want):
    assert "".join(b["text"] for b in merge.merge_ordered([P(c) for c in known], [P(c) for c in seen])) == want


@given(st.lists(st.sampled_from("ABCDE")), st.lists(st.sampled_from("ABCDE")))
@settings(max_examples=60, deadline=None)
def test_merging_laws(a, b):
    x, y = [P(c) for c in a], [P(c) for c in b]
    assert merge.distinct(merge.distinct(x)) == merge.distinct(x)
    assert merge.merge_ordered(x, x) == merge.distinct(x)
    assert sorted(m["text"] for m in merge.merge_ordered(x, y)) == sorted({*a, *b})


def plain_ordered(known, snapshot):
    """merge_ordered with a plain list."""
    order, fresh = [b["text"] for b in merge.distinct(known)], [b["text"] for b in merge.distinct(snapshot)]
    if not order:
        return fresh
    old, before = set(order), None
    for i, k in enumerate(fresh):
        if k not in old:
            following = next((x for x in fresh[i + 1 :] if x in old), None)
            at = order.index(before) if before is not None else None
            if following is not None and (at is None or at < order.index(following)):
                order.insert(order.index(following), k)
            else:
                order.insert(len(order) if at is None else at + 1, k)
        before = k
    return order


@given(st.lists(st.sampled_from("ABCDEFGH")), st.lists(st.sampled_from("ABCDEFGH")))
@settings(max_examples=300, deadline=None)
def test_ordered_against_a_plain_list(a, b):
    x, y = [P(c) for c in a], [P(c) for c in b]
    assert [m["text"] for m in merge.merge_ordered(x, y)] == plain_ordered(x, y)


def test_long_merges_are_quick():
    import time

    began = time.process_time()
    merge.merge_ordered([P(str(i)) for i in range(20_000)], [P(str(i)) for i in range(10_000, 30_000)])
    assert time.process_time() - began < 5


def test_distinct_and_fuse():
    assert [b["text"] for b in merge.distinct(map(P, "ABAC"))] == ["A", "B", "C"]
    got = merge.distinct([P("a", source_id="1"), P("b"), P("longer", source_id="1")])
    assert [b["text"] for b in got] == ["longer", "b"]
    assert merge.fuse(P("long", markdown="x"), P("s"))["text"] == "s"  # richness goes by the Markdown first
    assert merge.richness({"type": "table", "rows": [["a", ""], ["bc"]], "images": [1]}) == 3003


def test_fragments():
    joined = merge.merge_fragments([[P("0123 abcdefghijkl", markdown="m")], [P("abcdefghijkl 99")]])
    assert [(b["text"], b["markdown"]) for b in joined] == [("0123 abcdefghijkl 99", "m")]
    assert merge.merge_fragments([[P("0123 abcdefghijkl", markdown="m")], [P("abcdefghijkl 99")]], faithful=False)[0]["markdown"] is None
    ordered = merge.merge_fragments([[P("b", source_order=2.0), P("a", source_order=1.0)]])
    assert [b["text"] for b in ordered] == ["a", "b"]
    assert [b["text"] for b in merge.merge_fragments([[P("b", source_order=2.0), P("a")]])] == ["b", "a"]


def items(spark, *rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "page_id int, pos int, type string, text string, ordered boolean, depth int")


def test_islands(spark):
    df = items(spark, ("listItem", "1.", False, 0), ("listItem", "x", False, 1), ("paragraph", "p", None, None), ("listItem", "y", None, 0), ("listItem", "z", None, 1))
    joined = islands.join_split_numbers(df).orderBy("pos").collect()
    assert [(r.text, r.ordered, r.depth) for r in joined] == [("x", True, 0), ("p", None, None), ("y", None, 0), ("z", None, 1)]
    out = islands.compact_lists(islands.join_split_numbers(df)).orderBy("pos").collect()
    assert [(r.type, r.text, r.n_items) for r in out] == [("listItem", "x", 1), ("paragraph", "p", 1), ("paragraph", "- y\n    - z", 2)]
    quotes = islands.wrap_quotes(items(spark, ("paragraph", "a", None, 0), ("paragraph", "b", None, 0), ("code", "c", None, 0), ("paragraph", "d", None, 0))).orderBy("pos").collect()
    assert [(r.type, r.text) for r in quotes] == [("quote", "a\nb"), ("code", "c"), ("quote", "d")]


def test_media(spark):
    png = bytes.fromhex("89504E470D0A1A0A00")
    doc = spark.createDataFrame([(1, "https://e.com/p")], "page_id int, url string")
    block = lambda kind, src: f"named_struct('type','{kind}','text',null,'markdown',null,'level',null,'ordered',null,'depth',null,'language',null,'src','{src}','alt',null,'href',null,'rows',null,'images',null,'embedded_data_url',null,'source_id',null,'source_order',null)"
    doc = doc.withColumn("blocks", F.expr(f"array({block('image', '/a.png')}, {block('image', 'http://10.0.0.1/x.png')}, {block('video', '/v.mp4')}, {block('image', '/a.png')})").cast(f"array<{BLOCK}>"))
    assets = spark.createDataFrame([("https://e.com/a.png", 200, "image/png", png), ("https://e.com/v.mp4", 200, "video/mp4", b"no")], "url string, status int, content_type string, data binary")
    got = media_ops.localize(media_ops.media_list(doc), assets).orderBy("kind", "idx").collect()
    assert [(r.kind, r.idx, r.ok, r.file_name) for r in got] == [("image", 0, True, "image-001.png"), ("image", 1, False, None), ("image", 2, True, "image-003.png"), ("video", 0, False, None)]
    assert got[1].reason == "unsafe image URL: local or private destination" and got[3].reason == "video signature mismatch expected=mp4"


def test_export(spark):
    """Markdown and media of an archive, with pictures in tables, repeated and refused ones."""
    from leafmill.operators.export import export_entries

    png, gif = bytes.fromhex("89504E470D0A1A0A00"), b"GIF89a..."
    names = BLOCK[7:-1]
    fields = [f.split(":")[0] for f in ("type text markdown level ordered depth language src alt href rows images embedded_data_url source_id source_order").split()]
    assert all(f in names for f in fields)
    row = lambda **own: tuple(own.get(f) for f in fields)
    cell = lambda src, at: (src, "c", 0, at, None)
    blocks = [
        row(type="paragraph", text="Hello"), row(type="image", src="/a.png", alt="x"), row(type="table", rows=[["h", "i"], ["j"]], images=[cell("/b.gif", 0), cell("http://127.0.0.1/z.png", 1)]), row(type="image", src="data:image/svg+xml,x"),
        row(type="image", src="/a.png"), row(type="video", src="/v.mp4", text="Clip"), row(type="code", text="a ``` b", language="Py"),
    ]
    docs = spark.createDataFrame([(1, "https://e.com/p", "My: page", blocks), (2, "https://e.com/q", "Empty", [row(type="paragraph", text=" ")])], f"page_id long, url string, title string, blocks array<{BLOCK}>")
    assets = spark.createDataFrame([("https://e.com/a.png", 200, "image/png", png), ("https://e.com/b.gif", 200, "image/gif", gif), ("https://e.com/v.mp4", 500, "video/mp4", b"")], "url string, status int, content_type string, data binary")
    packed = zip_sink.zip_archives(export_entries(docs, assets, F.lit("2024-05-06 07:08:00").cast("timestamp")), "page_id").collect()
    assert [r.page_id for r in packed] == [1]
    archive = zipfile.ZipFile(io.BytesIO(bytes(packed[0].bytes)))
    base = "My- page__20240506-0708"
    media = f"{base}/My- page.assets"
    assert archive.testzip() is None
    assert {n: archive.read(n) for n in archive.namelist() if not n.endswith(".md")} == {f"{media}/image-001.png": png, f"{media}/image-002.gif": gif, f"{media}/image-004.png": png}
    want = "# My: page\n\nSource: https://e.com/p\nCaptured: 2024-05-06 07:08\n\nHello\n\n![x](./My-%20page.assets/image-001.png)\n\n| h<br>![c](./My-%20page.assets/image-002.gif) | i<br>![c](http://127.0.0.1/z.png) |\n| --- | --- |\n| j |  |\n\n![](./My-%20page.assets/image-004.png)\n\n[Clip](/v.mp4)\n\n````py\na ``` b\n````\n"
    assert archive.read(f"{base}/My- page.md").decode() == want


def test_fifo(spark):
    uses = spark.createDataFrame([(1, 0, "s"), (1, 1, "s"), (1, 2, "t")], "page_id int, at int, src string")
    results = spark.createDataFrame([(1, "s", 0, True, "image-001.png"), (1, "s", 1, False, None)], "page_id int, src string, idx int, ok boolean, file_name string")
    assert [r.local for r in media_ops.rewrite(uses, results, "at").orderBy("at").collect()] == ["image-001.png", None, None]


def test_zip(spark):
    rows = [("a", 0, "f/x.md", b"hello"), ("a", 1, "f/é.bin", b""), ("b", 0, "y", b"123456789")]
    df = spark.createDataFrame(rows, "archive_id string, seq int, path string, data binary")
    got = {r.archive_id: r for r in zip_sink.zip_archives(df).collect()}
    whole = zipfile.ZipFile(io.BytesIO(bytes(got["a"].bytes)))
    assert whole.testzip() is None and {n: whole.read(n) for n in whole.namelist()} == {"f/x.md": b"hello", "f/é.bin": b""}
    assert zipfile.ZipFile(io.BytesIO(bytes(got["b"].bytes))).getinfo("y").CRC == 3421780262
    again = spark.createDataFrame([("a", 0, "x", b""), ("a", 1, "x", b"")], df.schema)
    with pytest.raises(Exception, match="duplicate path"):
        zip_sink.zip_archives(again).collect()


@pytest.mark.parametrize("path, want", [("a/b.md", True), ("/a", False), ("a//b", False), ("../x", False), ("C:x", False), ("a\\b", False), ("", False), ("a/./b", True), ("a\n", False)])
def test_paths(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(zip_sink.safe_path(F.col("p"))).first()[0] is want


def test_collector_steps():
    state, seen = State(), [[P(str(i)) for i in range(n)] for n in (3, 5, 5, 5, 5, 5, 7)]
    for blocks in seen:
        state = step(state, Policy(), blocks)
    assert (state.status, state.rounds, len(state.blocks)) == ("idle", 6, 5)
    state = State()
    for blocks in seen:
        state = step(state, Policy(merge="latest", stable_bottom=True, idle=2, most_rounds=3), blocks, top=0, height=0)
    assert (state.status, state.rounds) == ("round-limit", 3)
    assert step(State(), Policy(), seen[0], moved=False).status == "bottom"


def test_stream_equals_batch(spark, tmp_path):
    rows = [(p, r, json.dumps([P(f"{p}{(r * k) % 5}") for k in range(3)]), True, 0.0, 0.0) for p in range(4) for r in range(12)]
    schema = "page_id long, round long, blocks string, moved boolean, scroll_top double, max_scroll_top double"
    for part in (0, 1, 2):
        spark.createDataFrame([x for x in rows if x[1] // 4 == part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = collect(stream, Policy()).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "marks")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    last = spark.read.parquet(str(tmp_path / "out")).groupBy("page_id").agg(F.max_by(F.struct("rounds", "n_blocks", "idle", "status", "blocks"), "rounds").alias("s")).select("page_id", "s.*")
    batch = collect_batch(spark.createDataFrame(rows, schema), Policy())
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, batch.collect()))
