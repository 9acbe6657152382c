import html
import os
import random
import re
import time

import pytest

from chronotopia.llm import html_text as M

PAGE = """<!DOCTYPE html><HTML><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header class=top><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav>
<div class="cookie-notice">We use, cookies, really, a lot, of them.</div><div id=wrap><article><header><h1>The &ldquo;title&rdquo;</h1></header>
<p>One, two &amp; three<br>four <b>bold<i>er</b> text&nbsp;here<!-- <p>no</p> -->, and <script>if (a < b) document.write("</p><p>x")</script>on.
<p class="lead">Next <span class="hidden">secret</span>one &lt;tag&gt; &#8211; &#x41;.</p><ul><li>first<li>second</ul><form><p>Your mail?</p><input value="x"></form>
<aside>side</aside><div class="ad">buy, now, cheap</div><ul class="x"><li><a href=1>Related story</a><li><a href=2>Another one</a><li><a href=3>A third</a></ul>
<blockquote>Quoted, text.</blockquote><table><tr><td>c1<td>c2</table><pre>  a
 b</pre><section class="comments"><article class="comment"><p>I, as a reader, think, that this, is, long, enough, to win, really.</p></article></section></article></div>
<div class="sidebar"><p>Other</p></div><footer>&copy; me</footer></body></html> tail"""
TEXT = "The “title”\nOne, two & three four bolder text here, and on.\nNext one <tag> – A.\nfirst\nsecond\nQuoted, text.\nc1\nc2\na b"


def test_a_page_with_all_that_goes():
    assert M.main_text(PAGE) == TEXT


def test_without_an_article_element():
    prose = "".join(f"<p>Sentence {i}, with commas, and some length to it so that it counts.</p>" for i in range(6))
    noise = '<div class="menu"><a href=1>x</a></div>' + "<div>" + "".join(f"<a href={i}>A link of some length {i}</a> " for i in range(30)) + "</div>"
    page = f"<body>{noise}<div><h2>Head</h2><div class=c>{prose}</div><p>A closing word of the author, outside of the container, that reads as prose.</p><p><a href=1>more</a></p></div><div class=footer>{prose}</div>"
    lines = M.main_text(page).split("\n")
    assert lines[0] == "Head" and len(lines) == 8 and lines[-1].startswith("A closing") and lines[1].startswith("Sentence 0")


def test_edges():
    assert [M.main_text(x) for x in (None, "", " \n", "<p>", "<script>x", "plain  text", "<p>a<p>b</p>c", "a<b", "a < b", "&amp;lt; &bogus; &am")] == ["", "", "", "", "", "plain text", "a\nb\nc", "a", "a < b", "&lt; &bogus; &am"]
    assert M.main_text("<article><p title='a>b' data-x=\"</p>\">x</p></article>") == "x"
    assert M.main_text("<p>one</P><DIV>two</DIV>") == "one\ntwo"


@pytest.mark.parametrize("unit", ["<div>", "<p ", '<a href="', "<a>x", "<!--", "<b>x<p>y", "</div>", "<table><tr><td>", "<li>", "&amp", "<", "<script>", "<ul><li><a>x", "<svg><g>"])
def test_long_and_broken_pages_take_linear_time(unit):
    began = time.process_time()
    M.main_text(unit * 30_000)
    assert time.process_time() - began < 5


def test_any_text_is_survived():
    rng = random.Random(8)
    bits = re.findall(r"<[^>]*>|[^<]{1,9}", PAGE) + ["<", ">", "\"", "'", "</", "<!", "<p", "&", "\0"]
    for _ in range(400):
        out = M.main_text("".join(rng.choice(bits) for _ in range(rng.randint(1, 80))))
        assert out == "\n".join(" ".join(x.split()) for x in out.split("\n")) and "\n\n" not in out


def plainly(page):
    """For pages of the tables: what stands in the article, cut at its marks."""
    body = page[page.index("<article>") : page.index("</article>")].replace("<br>", " ")
    found = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1|article)>", body)]
    return "\n".join(x for x in found if x)


def test_query(spark, tmp_path):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (None, "u", "", None), (1, "u", PAGE, "x"), (3, "v", "<article><p>" + "long, " * 200_000 + "</article>", "x")]
    spark.createDataFrame(rows, "page_id long, url string, html string, `text` string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in M.op13_html(spark, str(tmp_path)).collect()), key=str)
    long = ("long, " * 200_000).strip()
    assert got == sorted([(1, "u", TEXT, len(TEXT))] * 2 + [(2, None, "", 0), (None, "u", "", 0), (3, "v", long, len(long))], key=str)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert M.extract(empty).collect() == []


def test_pages_of_the_tables(spark):
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no tables here")
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    assert {r.page_id: r.text for r in M.op13_html(spark, d).collect()} == {i: plainly(p) for i, p in pages.items()}
