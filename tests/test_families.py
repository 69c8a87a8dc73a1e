from __future__ import annotations

from leafmill.operators.families.article import article_blocks
from leafmill.operators.families.course import course_blocks
from leafmill.operators.families.feishu import feishu_blocks
from leafmill.operators.families.wechat import wechat_blocks, wechat_coverage


def zone(*lines):
    return '<div class="zone-container" data-slate-editor="true">' + "".join(f'<div class="ace-line">{x}</div>' for x in lines) + "</div>"


def block(kind, number, inner, more="", tag="div"):
    return f'<{tag} class="block docx-{kind}-block {more}" data-block-id="{number}" data-record-id="r{number}">{inner}</{tag}>'


def test_feishu(spark):
    html = block(
        "page", 1,
        block("heading2", 2, zone("A <b>title</b>"))
        + block("text", 3, zone("one <a href='/x(1)'>li[n]k</a>", "", "<span style='font-weight: 700'>two</span><br>three"))
        + block("text", 4, zone("gone"), "isEmpty")
        + block("bullet", 5, zone("item") + block("ordered", 6, zone("inner")))
        + block("quote_container", 7, block("text", 8, zone("said")) + block("image", 9, "<img src='/q.png' alt='q'>"))
        + block("quote_container", 10, zone("bare"))
        + block("table", 11, f"<table><tr><td>a  b</td>{block('table_cell', 12, block('text', 13, zone('c', 'd')), tag='td')}</tr><tr><th>e</th></tr></table>")
        + block("code", 14, f"<div class='code-block-zone-container'>{zone('x = 1', 'y')}</div>")
        + block("image", 15, "<img data-src='i.png' src='data:image/svg+xml,x' alt=' p '><img src='/j.png'>")
        + block("text", 16, '<div class="zone-container" data-slate-editor="true">no  lines</div>')
        + block("text", 3, zone("one")),
    )
    rows = feishu_blocks(spark.createDataFrame([(1, "https://a.feishu.cn/docx/1", html), (2, "https://a.feishu.cn/docx/2", None)], "page_id long, url string, html string")).orderBy("pos").collect()
    assert [(r.type, r.text, r.markdown or r.src, r.depth, r.ordered) for r in rows] == [
        ("heading", "A title", None, None, None),
        ("paragraph", rows[1].text, "one [li\\[n\\]k](/x%281%29)<br>**two**<br>three", None, None),
        ("listItem", "item", "item", 0, False),
        ("listItem", "inner", "inner", 1, True),
        ("quote", "said", "said", None, None),
        ("image", None, "https://a.feishu.cn/q.png", None, None),
        ("quote", "bare", "bare", None, None),
        ("table", None, None, None, None),
        ("code", "x = 1\ny", None, None, None),
        ("image", None, "https://a.feishu.cn/docx/i.png", None, None),
        ("image", None, "https://a.feishu.cn/j.png", None, None),
        ("paragraph", "no lines", "no lines", None, None),
    ]
    assert rows[1].text.endswith("two three")
    assert rows[7].rows == [["a b", "c<br>d"], ["e"]]
    assert [r.source_id for r in rows[:3]] == ["feishu-block:r2", "feishu-block:r3", "feishu-block:r5"]
    assert [r.source_id for r in rows[9:11]] == ["feishu-image:r15:0", "feishu-image:r15:1"] and rows[5].source_id == "feishu-image:r9"


def item(inner, more=""):
    return f'<div class="vc-doc-item {more}">{inner}</div>'


def test_course(spark):
    text = lambda t: f'<div class="block-text">{t}</div>'
    html = "<main class='feishu-doc-content'><h2>Lesson</h2>" + "".join([
        item(text("Head"), "doc-heading-8"),
        item(text(" one <b> two </b><span class='italic'>x</span>") + text("three<br>four")),
        item('<div class="bullet_container number-1"><span class="bullet-dot">1.</span><div class="bulletlist">li</div></div>' + item('<div class="bulletlist">in <img src="/n.png"></div>') + item('<div class="bulletlist">in2</div>') + '<img src="/o.png">'),
        item('<div class="quote_container">' + item(text("q1")) + item(text("q2")) + "</div>"),
        item('<div class="block-code"><span class="block-code-language">Plain Text</span><pre class="block-code-content">\n  a  \nb\n</pre></div>'),
        item(f'<div class="table table_2"><div class="table_cell">{item(text("c1"))}{item(text("c2"))}</div><div class="table_cell">d</div><div class="table_cell">e</div></div>'),
        item('<div class="block-file video"><div class="title"><span>Clip</span></div><video class="video-preview" src="https://v.com/a b.mp4"></video></div>'),
        item('<div class="block-file video"><video class="video-preview" src="blob:x"></video></div>'),
        item("<img src='/images/docx/link.png'><img src='/p.png' alt='p'>"),
        '<div class="next-chapter-card">' + item(text("next")) + "</div>",
    ]) + "</main>"
    rows = course_blocks(spark.createDataFrame([(1, "https://scys.com/course/detail/1", html)], "page_id long, url string, html string")).orderBy("pos").collect()
    assert [(r.type, r.text, r.markdown or r.src, r.depth, r.ordered) for r in rows] == [
        ("heading", "Lesson", None, None, None),
        ("heading", "Head", None, None, None),
        ("paragraph", "one two x three four", "one **two** *x*<br>three<br>four", None, None),
        ("listItem", "li", "li", 0, True),
        ("image", None, "https://scys.com/o.png", None, None),
        ("listItem", "in", "in", 1, False),
        ("image", None, "https://scys.com/n.png", None, None),
        ("listItem", "in2", "in2", 1, False),
        ("quote", "q1 q2", "q1\nq2", None, None),
        ("code", "  a\nb", None, None, None),
        ("table", None, None, None, None),
        ("video", "Clip", "https://v.com/a%20b.mp4", None, None),
        ("image", None, "https://scys.com/p.png", None, None),
    ]
    assert rows[1].level == 6 and rows[9].language == "text" and rows[10].rows == [["c1<br>c2", "d"], ["e", ""]]
    assert [r.source_id for r in rows if r.source_id] == ["scys:3:image:0", "scys:3:nested:0:image:0", "scys:6:table", "scys:7:video:0", "scys:9:image:0"]


def test_article(spark):
    text = lambda t: f'<div class="block-text">{t}</div>'
    bullet = lambda t, more="": f'<div class="bullet_container {more}"><div class="bulletlist">{t}</div></div>'
    opening = '<div class="post-content">Hello <b>there</b><br>1、first<br>2. second<br><br>end</div>'
    html = f"<main><div class='content-container'><h1 class='post-title'>The title</h1>{opening}<div class='feishu-doc-content'><h1>The title</h1><h2>Part</h2>" + "".join([
        item(text("a<img src='/1.png'>b") + item(text("inner")) + text("c")),
        item(bullet("1.")) + item(bullet("one")) + item(bullet("two") + item(bullet("deep"))),
        item(text("x")),
        item(bullet("single")),
        item('<div class="quote_container">' + item(text("q1")) + item(text("q2<img src='/2.png'>q3")) + "</div>"),
        item(text("Head"), "doc-heading-4"),
        item('<div class="block-code"><pre class="block-code-content">\n  z\n</pre></div>'),
    ]) + "</div></div></main>"
    rows = article_blocks(spark.createDataFrame([(1, "https://scys.com/articleDetail/xq_topic/1", html)], "page_id long, url string, html string")).orderBy("pos").collect()
    got = [(r.type, r.markdown or r.src or r.text) for r in rows]
    assert got == [
        ("paragraph", "Hello **there**"), ("paragraph", "1. first\n1. second"), ("paragraph", "end"), ("heading", "Part"),
        ("paragraph", "a"), ("image", "https://scys.com/1.png"), ("paragraph", "b"), ("paragraph", "inner"), ("paragraph", "c"),
        ("paragraph", "1. one\n- two\n    - deep"), ("paragraph", "x"), ("listItem", "single"),
        ("quote", "q1\nq2"), ("image", "https://scys.com/2.png"), ("quote", "q3"), ("heading", "Head"), ("code", "  z"),
    ]


def test_wechat(spark):
    tree = "src/<br>├── a<br>└── b"
    html = f"""<div id="js_content" style="visibility: hidden;"><h2>Title</h2><p>One <strong>two </strong>three <a href="https://e.com/x">li</a><br>four</p><strong> </strong>
<p style="display:none">hidden</p><script>no</script><p><img data-src="https://mmbiz.qpic.cn/a?wx_fmt=png&amp;tp=webp" alt="p"></p><p>after</p><img src="https://mmbiz.qpic.cn/a?wx_fmt=png#x"><p>more</p>
<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul><ol start="3"><li><p>d</p></li></ol><blockquote><p>q</p><p>r</p></blockquote>
<section class="code-snippet__fix"><ul class="code-snippet__line-index"><li>1</li></ul><pre class="code-snippet" data-lang="js"><code>x = 1</code><code>y</code></pre></section>
<table><tr><th>h</th><th>i</th></tr><tr><td><p>j</p><p>k|l</p></td></tr></table><p>{tree}</p><img data-src="data:image/svg+xml,x"></div>"""
    pages = spark.createDataFrame([(1, "https://mp.weixin.qq.com/s/1", html), (2, "u", "<p>x</p>"), (3, "u", None)], "page_id long, url string, html string")
    blocks = wechat_blocks(pages)
    rows = blocks.orderBy("pos").collect()
    assert [(r.page_id, r.type, r.source_id) for r in rows] == [(1, "paragraph", "wechat:text:1"), (1, "image", "wechat:image:https://mmbiz.qpic.cn/a?wx_fmt=png"), (1, "paragraph", "wechat:text:2")]
    assert rows[0].markdown == "## Title\n\nOne **two** three [li](https://e.com/x)\nfour" and rows[0].text == "Title One two three li four"
    assert rows[2].markdown.split("\n\n") == [
        "after", "more", "- a\n    - b\n- c\n3. d", "> q\n>\n> r", "```js\nx = 1\ny\n```", "| h | i |\n| --- | --- |\n| j k\\|l |  |", "```text\nsrc/\n├── a\n└── b\n```",
    ]
    seen = wechat_coverage(pages, blocks).collect()
    assert [(r.page_id, r.images, r.code_blocks, r.tables, r.warn) for r in seen] == [(1, 1, 1, 1, False)] and seen[0].percent > 70


def test_wechat_line_marks(spark):
    """A plus sign makes a list only with a space after it, so that of a phone number stays as it is."""
    pages = spark.createDataFrame([(1, "https://mp.weixin.qq.com/s/1", '<div id="js_content"><p>+1 (477) 555-4197 x</p><p>+ y</p><p>- z</p></div>')], "page_id long, url string, html string")
    assert [r.markdown for r in wechat_blocks(pages).collect()] == ["+1 (477) 555-4197 x\n\n\\+ y\n\n\\- z"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_wechat_pages_are_parsed_once_and_move_once(spark):
    pages = spark.createDataFrame([(1, "https://mp.weixin.qq.com/s/1", '<div id="js_content"><p>a</p></div>')], "page_id long, url string, html string")
    plan = plan_of(wechat_blocks(pages))
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange") == 1


def test_plain_tags_are_read_as_the_parser_reads_them():
    from leafmill.sources.html_nodes import _Tree

    plain = '<div id="a" class="b &amp; c" id="d">x &lt; y<br/><p>z<p hidden="">u</b></div><table><tr><td>v<li>w</td></tr>&am'
    fast, slow = _Tree(), _Tree()
    slow._plain = lambda html: False
    fast.finish(plain)
    slow.finish(plain)
    for name in ("tags", "attrs", "parents", "children", "pieces", "faded", "ranges", "undisplayed", "dim"):
        assert getattr(fast, name) == getattr(slow, name)
    for odd in ("<p x>", "<!-- a -->", "<script>a</script>", '<a title="b>c">', "a < b", "<p", "</p >"):
        assert not _Tree()._plain(odd)


def test_coverage_from_one_parse(spark):
    from leafmill.operators.families.wechat import page_coverage

    html = '<div id="js_content"><p>One <b>two</b> 😀</p><p><img data-src="https://e.com/a.png"></p><pre>x = 1</pre><table><tr><td>k</td></tr></table></div>'
    pages = spark.createDataFrame([(1, "https://mp.weixin.qq.com/s/1", html), (2, "u", '<div id="js_content"></div>'), (3, "u", "<p>x</p>")], "page_id long, url string, html string")
    found, plain = page_coverage(pages), wechat_coverage(pages, wechat_blocks(pages))
    assert plan_of(found).count("MapInArrow") == 1
    assert sorted(found.select(*plain.columns).collect()) == sorted(plain.collect()) and found.count() == 2


def test_feishu_pages_are_parsed_once_and_move_once(spark):
    pages = spark.createDataFrame([(1, "https://a.feishu.cn/docx/1", block("page", 1, block("text", 2, zone("a"))))], "page_id long, url string, html string")
    found = feishu_blocks(pages)
    assert plan_of(found).count("MapInArrow") == 1 and plan_of(found).count("Exchange") == 1
    assert [(r.pos, r.markdown) for r in found.collect()] == [(1, "a")]


def test_course_pages_are_parsed_once_and_move_once(spark):
    pages = spark.createDataFrame([(1, "https://scys.com/course/detail/1", "<main>" + item('<div class="block-text">a</div>') + "</main>")], "page_id long, url string, html string")
    found = course_blocks(pages)
    assert plan_of(found).count("MapInArrow") == 1 and plan_of(found).count("Exchange") == 1
    assert [(r.pos, r.markdown) for r in found.collect()] == [(1, "a")]


def test_article_pages_are_parsed_once_and_move_once(spark):
    pages = spark.createDataFrame([(1, "https://scys.com/articleDetail/xq_topic/1", '<div class="feishu-doc-content">' + item('<div class="block-text">a</div>') + "</div>")], "page_id long, url string, html string")
    found = article_blocks(pages)
    assert plan_of(found).count("MapInArrow") == 1 and plan_of(found).count("Exchange") == 1
    assert [(r.pos, r.markdown) for r in found.collect()] == [(1, "a")]
