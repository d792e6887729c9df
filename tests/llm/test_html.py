"""Main text of pages: hand-made pages, wrapper induction, odd rows."""

import os
import re
from html import unescape

import pytest

from tagtrail.llm import html_text as h
from tagtrail.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def text(source):
    return h._content([h.Page(source)])[0]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_table(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").collect()
    got = {r["page_id"]: r for r in QUERIES["op2_html_text"](spark, FOLDER).collect()}
    assert len(got) == len(pages)
    for p in pages:
        article = re.search(r"<article>(.*?)(</article>|$)", p["html"], re.S)[1]
        plain = re.sub(r"</?(p|h1|br)>", " ", article)
        plain = " ".join(unescape(re.sub(r"<[^>]*>", "", plain)).split())
        assert got[p["page_id"]]["text"] == plain and got[p["page_id"]]["n_chars"] == len(plain)


@pytest.mark.parametrize("source,expected", [
    ("<p>a<b>b</b>c <i>d</i></p><p>e", "abc d e"),
    ("<p>one<p>two<ul><li>x<li>y</ul>three", "one two x y three"),
    ("<script>var a='</p><p>no';</script>yes<style>no</style>", "yes"),
    ("<script>never closed", ""), ("a<!-- <p>no</p> -->b", "ab"), ("a<br>b", "a b"),
    ("&lt;b&gt; &amp;amp; &#233;&nbsp;&hellip;", "<b> &amp; é …"),
    ('<a title="a > b">link</a> <img alt="no"> end', "link end"),
    ("<nav>no</nav><header>no</header><main><p>in</p></main><p>out</p><footer>no</footer>", "in"),
    ('<div class="side-bar ad-box">no</div><div id="content">yes</div>', "yes"),
    ('<div class="download address">yes</div>', "yes"),
    ("<article><h1>T</h1>x<section class='comments'><article>no</article></section></article>", "T x"),
    ('<article><div>a</div><form>no<input><button>b</button></form><aside>no</aside>c</article>', "a c"),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2 3"), ("5 < 6 and 7 > 3", "5 < 6 and 7 > 3"),
    ("<p>cut <b", "cut <b"), ("</p></div>stray", "stray"), ("<p>\n a \t b c </p>", "a b c"),
    ("<title>no</title><body>yes</body></html>", "yes"), ("<![CDATA[x]]>", "x")])
def test_one_page(source, expected):
    assert text(source) == expected


def page(i, ad="Buy now", extra=""):
    return (f"<html><body><div id=top>Site of things</div><div><p>{ad}</p></div>{extra}"
            f"<div id=c><p>Story {i} begins.</p><p>All rights reserved.</p><p>Ends {i * 7}.</p></div>"
            f"<div id=legal><p>Imprint</p></div></body></html>")


def test_constant_nodes_are_template():
    pages = [h.Page(page(i)) for i in range(10)]
    assert h._content(pages) == [f"Story {i} begins. Ends {i * 7}." for i in range(10)]


def test_few_pages_and_copies_are_no_template():
    assert "Imprint" in h._content([h.Page(page(i)) for i in range(7)])[0]
    copies = [h.Page("<div><p>Same story.</p></div>") for _ in range(40)]
    assert h._content(copies) == ["Same story."] * 40
    mixed = copies + [h.Page(f"<div><p>Story {i}.</p></div>") for i in range(9)]
    assert h._content(mixed)[0] == "Same story."


def test_tree_matching():
    a, b = h.Page("<div><h1>x</h1><p>y</p></div><ul><li>z</ul>").root, \
        h.Page("<div><p>y</p></div><hr><ul><li>z<li>w</ul>").root
    size, pairs = h.match(a, b)
    assert size == 5 and all(x.label == y.label for x, y in pairs)


def test_odd_rows(spark):
    rows = [(1, "http://a.b/x", None), (2, None, ""), (None, "nonsense", "<p>x</p>"),
            (3, "http://a.b/x", "<p>y</p>"), (3, "http://a.b/x", "<p>y</p>"),
            (4, "HTTP://u@A.B:80/", "<div>" * 5000 + "deep" + "</div>" * 5000),
            (5, "http://a.b", "<p>" + "long " * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string") \
        .selectExpr("*", "1 AS host", "2 AS task")
    got = {}
    for r in h.extract(df).collect():
        got.setdefault(r["page_id"], []).append(r["text"])
    assert got == {1: [""], 2: [""], None: ["x"], 3: ["y", "y"], 4: ["deep"],
                   5: [" ".join(["long"] * 100_000)]}
    assert h.extract(df.where("false")).count() == 0


def test_a_large_host_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(h, "SHARE", 10)
    rows = [(i, "http://big.example/" + str(i), page(i)) for i in range(300)]
    got = h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {
        i: f"Story {i} begins. Ends {i * 7}." for i in range(300)}
