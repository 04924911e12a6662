import html
import random
import re
import time

import pytest

from tablecare.llm import pages
from tablecare.llm.pages import Page

PROSE = [
    "The river rose during the night, and by morning the lower road, the mill and two barns stood in water.",
    "Short one.",
    "Nobody had expected it so early in the year, least of all the farmers, who had only begun to sow.",
]


def text(page):
    return Page(page).text()


def plain(page):
    """What stands between borders of blocks in the only article of a page without anything else in it."""
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = [html.unescape(re.sub("<[^>]*>", "", b)) for b in re.split(r"</?(?:p|h1)>|<br>", inner)]
    return "\n".join(" ".join(b.split()) for b in blocks if b.strip())


def test_given_pages_by_plain_extraction(spark):
    out = pages.op12_html_text(spark, "/root/testdata/sf0.01").toPandas()
    given = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").toPandas().set_index("page_id")
    assert len(out) == len(given) and list(out) == ["page_id", "url", "text", "n_chars"]
    for r in out.itertuples():
        assert r.text == plain(given.html[r.page_id]) and r.url == given.url[r.page_id] and r.n_chars == len(r.text)


CHROME = [
    "<header><h1>The Daily Site</h1><p>News, weather, sport, and more, every day, for everyone.</p></header>",
    '<nav><ul><li><a href="/a">Home</a><li><a href="/b">World</a></ul></nav>',
    '<div class="topMenu"><a href="/a">Home</a> <a href="/b">World</a></div>',
    '<ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li><li><a href="/3">Three</a></li></ul>',
    '<div id="cookie-notice"><p>We use cookies, as everybody does, to make this site work, and to count you.</p></div>',
    '<div role="alert">Our app is new, take it along, read everywhere, and even without a network.</div>',
    '<aside><p>Elsewhere: a dog, a cat, and a goat, all in one boat, and what came of it in the end.</p></aside>',
    '<div class="side ad"><p>Buy two, pay for one, but only today, only here, and only while we have any.</p></div>',
    "<form><p>Sign up, it is free, and you can leave whenever you like, no questions asked.</p><input name=q></form>",
    "<script>if (a < b) document.write('<p>Not, ever, text</p>')</script><style>p > a { color: red }</style>",
    '<p style="display: none">Hidden words, that nobody sees, but every crawler reads.</p><p hidden>So are these.</p>',
    "<!-- <p>A comment, not text.</p> --><noscript><p>Turn scripts on, please, or go elsewhere.</p></noscript>",
    "<footer><p>&copy; The Daily Site, all rights reserved, imprint, privacy, and terms.</p></footer>",
]
COMMENTS = (
    '<section id="comments"><h2>Comments</h2><article class="comment"><p>First, as ever, and right, as ever, too, '
    "if you ask me, which nobody does.</p></article><div><p>I read it, twice, and I still do not see the point, sorry.</p></div></section>"
)


@pytest.mark.parametrize("wrap", [
    "<article><h1>Flood</h1>{0}</article>",
    "<article><header><h1>Flood</h1></header><div class='body'>{0}</div></article>",
    "<main><h1>Flood</h1><div>{0}</div></main>",
    "<div role='main'><h1>Flood</h1>{0}</div>",
    "<div class='page'><div id='content'><h1>Flood</h1>{0}</div></div>",
    "<div class='x1'><h1>Flood</h1><div class='x2'>{0}</div></div>",
    "<table><tr><td><h1>Flood</h1>{0}</td></tr></table>",
    "<form id='page'><div><h1>Flood</h1>{0}</div></form>",
    "<article><h1>Flood</h1><section><h2></h2>{0}</section></article>",
])
def test_article_among_chrome(wrap):
    paragraphs = "".join(f"<p>{p}" for p in PROSE * 2)
    want = "\n".join(["Flood", *PROSE, *PROSE])
    for seed in range(8):
        random.seed(seed)
        chrome = random.sample(CHROME, len(CHROME))
        k = random.randint(0, len(chrome))
        page = "".join(chrome[:k]) + wrap.format(paragraphs) + COMMENTS + "".join(chrome[k:])
        page = f"<!DOCTYPE html><html><head><title>Flood, again</title></head><body class='has-sidebar'>{page}</body></html>"
        assert text(page) == want


def test_blocks_spaces_and_references():
    assert text("<p>a\n b&nbsp;&#32;c<b>d</b>e  <i>f</i></p><p> </p><p>&lt;x&gt; &eacute; &#x4E2D; &unknown; &amp</p>") == (
        "a b cde f\n<x> é 中 &unknown; &"
    )
    assert text("<article>one<br>two<br><br>three<hr>four<ul><li>five<li>six</ul><table><tr><td>7<td>8</table></article>") == (
        "one two\nthree\nfour\nfive\nsix\n7\n8"
    )
    assert text("<article><p><b>Bold, left open.<br><p>Next.<div>Inner <span>text</span></div>after</article>") == (
        "Bold, left open.\nNext.\nInner text\nafter"
    )
    assert text("<article><p>1 < 2 and a<b</p></article>") == "1 < 2 and a"
    assert text('<article><p title="a > b" class=x>Quoted.</p><a href=\'">\'>link</a> text</article>') == "Quoted.\nlink text"


def test_within_an_article():
    page = (
        "<article><h1>T</h1><p>First, of all, a sentence.</p><aside>See also, this, and that.</aside>"
        '<div class="share-bar"><a href="#">Tweet</a></div><blockquote><p>Quoted, at some length.</p></blockquote>'
        "<pre>code\n  more</pre><figure><img src=x><figcaption>A caption.</figcaption></figure>"
        '<p>See <a href="/x">a long linked phrase</a>.</p><footer>Filed under: news</footer></article>'
    )
    assert text(page) == "T\nFirst, of all, a sentence.\nQuoted, at some length.\ncode more\nA caption.\nSee a long linked phrase."


def test_defined_cases(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "plain, text", "x"), (3, "u", "<p>same</p>", "x"), (3, "u", "<p>same</p>", "x")]
    rows += [(4, "u", "<script>only()</script>", "x"), (5, "u", "<p>kept</p><!-- open <p>lost</p>", "x"), (6, "u", "<p>kept<a href=", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = pages.main_text(df).collect()
    want = [(1, "u", ""), (2, None, ""), (None, "u", "plain, text"), (3, "u", "same"), (3, "u", "same"), (4, "u", ""), (5, "u", "kept"), (6, "u", "kept")]
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)
    assert pages.main_text(df.where("false")).count() == 0


@pytest.mark.parametrize("page", [
    "<div>" * 100_000 + "deep",
    "<p><b>" * 50_000 + "x",
    "<a <a " * 50_000,
    '<a href="' * 50_000 + ">",
    "<p><table><span>" + "<div>x</b>" * 30_000,
    "<ul><span>" * 400 + "<li>x</ul>" * 30_000,
    "&amp" * 100_000,
    "<" * 200_000,
    "<!-" * 100_000,
    "<article>" + "<p>A sentence, of words.</p>" * 30_000 + "</article>",
])
def test_strange_pages_take_linear_time(page):
    start = time.perf_counter()
    text(page)
    assert time.perf_counter() - start < 20
