from __future__ import annotations

import html
import re
import time

import pytest

from leafmill.llm import html_extract as H

PLAIN = H.Weights.fit({})

PAGE = """<html><head><title>T</title></head><body class="has-sidebar"><header><h2>Site Name</h2><nav><a href=/>Home</a></nav></header>
<div class="cookie-notice">We use cookies to do things. Accept.</div><div class="content with-sidebar"><article><header><h1>Real &amp; title</h1></header>
<p>First para<b> bold</b> text goes here and on.<div class=ad>Buy now cheap cheap</div><p>Second para &eacute;&#39;s<br>line<ul><li>one<li>two</ul>
<blockquote>Quote <i>me</i></blockquote><table><tr><td>a<td>b</table><form>Sign up <input></form><aside>Related stuff here</aside><p>Last.</p>
<section class="comments"><h3>Comments</h3><p>I think this is a great long comment by a reader with many words in it.</p></section></article></div>
<aside class="sidebar"><p>Popular posts and some other text that is long</p></aside><footer><p>Copyright</p></footer><script>var a = "</p> <article>x";</script></body></html>"""


def test_article():
    assert H.main_text(PAGE, PLAIN).split("\n") == ["Real & title", "First para bold text goes here and on.", "Second para é's line", "one", "two", "Quote me", "a", "b", "Last."]


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("<", "<"), ("a < b", "a < b"), ("plain text only", "plain text only"), ("<p>x", "x"), ("<!-- x", ""), ("<script>alert(1)", ""), ("&lt;p&gt;", "<p>"),
    ("<p>a\n b&nbsp; c</p>", "a b c"), ("<nav>menu items only</nav>", ""), ("<p hidden>secret words</p><p>seen</p>", "seen"),
    ("<body><div id=menu><a>x</a> <a>y</a></div><div>Plain text in a div with words.</div><div>More of it here.</div><div class=footer>c 2020</div></body>", "Plain text in a div with words.\nMore of it here."),
    ("<div><p>" * 300 + "deep", "deep"),
])
def test_pages(page, want):
    assert H.main_text(page, PLAIN) == want


# Authored pages with the exact text of each.
AUTHORED = {
    "names that only sound like chrome": (
        """<body><div class="site-header"><a href=/>Daily</a></div><article><h1>Markets</h1><p class="share-price">The share price rose by a tenth.</p>
        <div class="comment-on-law"><p>A comment on the new law follows here.</p></div><label>Figures in euros</label><p>It closed higher.</p></article></body>""",
        "Markets\nThe share price rose by a tenth.\nA comment on the new law follows here.\nFigures in euros\nIt closed higher.",
    ),
    "comments by other names": (
        """<body><main><article><h1>Title here</h1><p>One paragraph of the article itself.</p><p>And another one of it.</p></article>
        <div id="responses"><p>I liked this a lot, thank you for the many words of it.</p></div><section class="discussion"><ol><li><b>ann</b> No, I did not like it at all.</li></ol></section></main></body>""",
        "Title here\nOne paragraph of the article itself.\nAnd another one of it.",
    ),
    "comments inside the article": (
        """<article><h2>Head</h2><p>Text of the article.</p><section class="reader-comments"><article class="comment"><p>First! This is long enough to be taken for text.</p></article></section><p>Last words of it.</p></article>""",
        "Head\nText of the article.\nLast words of it.",
    ),
    "no article element": (
        """<html><head><title>x</title><style>p{}</style></head><body><ul id="main-nav"><li><a href=a>One</a><li><a href=b>Two</a></ul><div class="post"><h1>Bread</h1>
        <p>Mix <a href=f>flour</a> and water, then wait.</p><p>Bake it for an hour.</p></div><div class="related-posts"><a href=1>Cake recipes for all</a></div>
        <form><label>Your e-mail</label><input><button>Send</button></form><div class="site-footer">All rights kept</div></body></html>""",
        "Bread\nMix flour and water, then wait.\nBake it for an hour.",
    ),
    "sidebar, notices and adverts": (
        """<body><div class="cookie-notice">We use cookies. Do you agree with that?</div><div class="page with-sidebar"><aside><p>Most read stories of the week</p></aside>
        <article><header><h1>On rain</h1></header><p>It rains.<div class="ad-slot"><p>Buy umbrellas now, they are cheap this week.</p></div><p>It will stop.</p><div class="share-buttons">Share Tweet Pin</div></article></div>
        <div role="complementary"><p>Weather for the week, in all towns of the land.</p></div></body>""",
        "On rain\nIt rains.\nIt will stop.",
    ),
    "white space and references": ("<article><p>a\n\t b&nbsp;&amp;&#x20;c<br>d</p><pre>x\n y</pre></article>", "a b & c d\nx y"),
}


@pytest.mark.parametrize("name", AUTHORED)
def test_authored_pages(name):
    page, want = AUTHORED[name]
    assert H.main_text(page, PLAIN) == want


def test_learned_names_beat_the_priors():
    """Pages whose article is full of a name that the priors hold against it, and whose chrome has a name of its own."""
    page = "<body><div class=zork>" + "<p>some words of chrome</p>" * 9 + "</div><div class='widget'><article>" + "<p>words of the article that count</p>" * 30 + "</article></div></body>"
    weights = H.Weights.fit(H.count_features([page] * 20))
    assert weights.of("as!widget") > 0 > weights.of("as:zork")
    assert H.main_text(page, weights) == "\n".join(["words of the article that count"] * 30)


@pytest.mark.parametrize("unit", [
    "<a ", "<div>", "<div class=c%d>", "<p><button><div>", "<script></script ", '<a "', "<a '\">", "<a =\"", "<!", "<", "</", "&", "<b><p>", "<table><tr><td>", "<ul><li>", "<x%d>", "<a href=%d>x</a>",
])
def test_hostile_pages_take_linear_time(unit):
    page = "".join(unit.replace("%d", str(i)) for i in range(1_000_000 // len(unit))) + "end"
    began = time.process_time()
    H.main_text(page, PLAIN)
    H.count_features([page])
    assert time.process_time() - began < 20


def test_run():
    def slow(s):
        best = max(((sum(s[i:j]), -i, -j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=(0, 0, 0))
        return best[0] if best[0] > 0 else 0.0

    for s in ([], [-1.0], [1.0, -2.0, 3.0], [2.0, -1.0, 2.0, -5.0, 3.5], [-1.0, 4.0, -1.0, -1.0, 3.0]):
        low, high = H.best_run(s)
        assert sum(s[low:high]) == slow(s)


def truth(page):
    inner = re.search(r"(?s)<article>(.*?)</article>", page)[1]
    parts = [" ".join(html.unescape(re.sub(r"</?b>|<br>", " ", p) if "<br>" in p else re.sub("</?b>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(p for p in parts if p)


def test_whole_table(spark):
    from llm_data import SF

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r.page_id: truth(r.html) for r in pages.collect()}
    got = H.extract_text(pages).collect()
    assert {r.page_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


def test_edges(spark):
    schema = "page_id long, url string, html string, text string, extra string"
    assert H.extract_text(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "u", None, "t", "x"), (None, None, "<article><p>a b c</p></article>", "t", "x"), (2, "u", "<p>q</p>", "t", "x"), (2, "u", "<p>q</p>", "t", "x"), (3, "u", "<p>" + "w " * 100_000 + "</p>", "t", "x")]
    out = sorted((r.page_id or 0, r.text[:5], r.n_chars, r.extra) for r in H.extract_text(spark.createDataFrame(rows, schema)).collect())
    assert out == [(0, "a b c", 5, "x"), (1, "", 0, "x"), (2, "q", 1, "x"), (2, "q", 1, "x"), (3, "w w w", 199_999, "x")]
