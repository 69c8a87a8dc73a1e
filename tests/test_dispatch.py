from __future__ import annotations

from leafmill.operators import blocks as B
from leafmill.operators import dispatch
from leafmill.sources import block_table

LONG = "word " * 40
ITEM = '<div class="vc-doc-item"><div class="block-text">%s</div></div>'
DOC = f"<main><h1>Top title</h1><div class='feishu-doc-content'>{ITEM % 'one'}{ITEM % 'two'}</div></main>"
PLAIN = f"<article><p>{LONG}</p><img src='x.png'></article>"
PAGES = [
    (1, "https://mp.weixin.qq.com/s/1", "<meta property='og:title' content=' From  meta '><div id=js_content><p>a</p></div>"),
    (2, "https://mp.weixin.qq.com/s/2", f"<title>T2</title><h1 id=activity-name> </h1>{PLAIN}"),  # no root
    (3, "https://scys.com/articleDetail/xq_topic/3", DOC),
    (4, "https://scys.com/course/detail/4", f"<title>S</title>{DOC}"),
    (5, "https://scys.com/course/detail/5", f"<main><p>{LONG}</p></main><div class=vc-course-content>{ITEM % 'x'}<div class=feishu-doc-content></div></div>"),  # the first root lacks items
    (6, "https://a.feishu.cn/docx/6", '<div class="block docx-page-block" data-block-id="0"><div class=docx-title>F</div><div class="block docx-text-block" data-block-id="1"><div class=zone-container data-slate-editor=true>z</div></div></div>'),
    (7, "https://e.com/a/7", f"<title></title>{PLAIN}"),
    (8, "https://e.com/8", None),
    (9, None, PLAIN),
    (10, "https://evil-feishu.cn/docx/6", '<div class="docx-page-block"></div>'),
    (11, "https://scys.com/articleDetail/xq_topic/3", "<title>Own name | 生财有术 x</title><h1>abc</h1><div class='feishu-doc-content'>" + ITEM % "q" + "</div>"),
]


def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string")


def test_roots_and_titles(spark):
    got = {r.page_id: (r.family, r.title) for r in dispatch.parse(pages(spark)).titles().collect()}
    assert got == {
        1: ("wechat", "From meta"), 2: ("generic", "T2"), 3: ("scys-article", "Top title"), 4: ("scys", "Top title"), 5: ("generic", "Web Clip"), 6: ("feishu", "F"), 7: ("generic", "Web Clip"),
        8: ("generic", "Web Clip"), 9: ("generic", "Web Clip"), 10: ("generic", "Web Clip"), 11: ("scys-article", "Own name"),
    }


def test_each_page_as_its_reader_reads_it(spark):
    got = {}
    for r in dispatch.read_pages(pages(spark)).orderBy("page_id", "pos").collect():
        got.setdefault((r.page_id, r.family), []).append((r.pos, r.type, r.text or r.src))
    one = lambda *texts: [(n, "paragraph", t) for n, t in enumerate(texts, 1)]
    whole = lambda folder: [(1, "paragraph", LONG.strip()), (2, "image", f"{folder}x.png")]
    assert got == {
        (1, "wechat"): one("a"), (2, "generic"): [(1, "paragraph", LONG.strip()), (2, "image", "https://mp.weixin.qq.com/s/x.png")], (3, "scys-article"): one("one", "two"), (4, "scys"): one("one", "two"),
        (5, "generic"): one(LONG.strip()), (6, "feishu"): one("z"), (7, "generic"): whole("https://e.com/a/"), (9, "generic"): whole("/"), (11, "scys-article"): one("q"),
    }


def test_table_function(spark):
    block_table.register(spark)
    pages(spark).createOrReplaceTempView("authored")
    by_sql = spark.sql("select a.page_id, b.* from authored a, lateral extract_blocks(a.html, a.url) b order by page_id, pos").collect()
    by_frame = B.page_blocks(pages(spark)).drop("url").orderBy("page_id", "pos").collect()
    assert [tuple(r) for r in by_sql] == [tuple(r) for r in by_frame] and len(by_sql) > 4


def test_a_phone_number_on_an_account_page(spark):
    made = spark.createDataFrame([(1, "https://mp.weixin.qq.com/s/1", "<div id=js_content><p>+1 (389) 555-5010 a</p></div>")], "page_id long, url string, html string")
    assert [r.markdown for r in dispatch.read_pages(made).collect()] == ["+1 (389) 555-5010 a"]


def test_readers_keep_no_blocks_on_disk(spark):
    """The parsed rows are kept, the readers' blocks aren't."""
    import os
    import urllib.parse

    folder = urllib.parse.urlparse(spark.conf.get("spark.checkpoint.dir")).path
    before = set(os.listdir(folder))
    dispatch.read_pages(pages(spark)).count()
    assert [n.rpartition("-")[0] for n in set(os.listdir(folder)) - before] == ["leafmill-site-pages"]
