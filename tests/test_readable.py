"""Readable text of pages, references, snippets: what the rules say for odd markup."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import markup
from millrace.operators import readable as R
from millrace.operators.readable import readable

LONG = "word " * 60
PAGES = {
    "null": (None, ""),
    "empty": ("", ""),
    "tags alone": ("<div><br></div>", ""),
    "plain": (" just \n text ", "just text"),
    "script": ("<p>before</p><script>if (1 < 2 && '</p>') x</script><style>p{}</style><p>after</p>", "before\n\nafter"),
    "headings": ("<h1>One</h1><h3> Two <b>bold</b></h3><p>text", "# One\n\n### Two bold\n\ntext"),
    "list": ("<p>a</p><ul><li>x<li> y </li></ul>b", "a\n\n- x\n- y\n\nb"),
    "paragraph in item": ("<ul><li><p>x</p></li></ul>", "-\nx"),
    "nav": ("<nav>menu<nav>inner</nav>still</nav>kept<footer>no</footer>", "kept"),
    "chrome div": ("<div class='main sidebar-2'><div>in</div>still</div><div>kept</div>", "kept"),
    "ad is a word": ("<div class='header'>kept</div><div id=ad>no</div><p class='social'>too</p>", "kept\ntoo"),
    "role": ('<section role="navigation">no</section>yes', "yes"),
    "data-class is no class": ('<div data-class="ad">yes</div>', "yes"),
    "unclosed chrome": ("a<aside>b<p>c", "a"),
    "void input": ("a<input>b", "a\nb"),
    "stray ends": ("</div></p>a</nav>b", "ab"),
    "cells": ("<table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table>", "a b\nc"),
    "inline": ("one<b>two</b> <i>three</i>\n<i> four</i>", "onetwo three four"),
    "pre": ("x<pre>  a\n   b\n\n</pre>y", "x\n\n  a\n   b\n\ny"),
    "less than": ("1 < 2 and 3 <4> 5 <", "1 < 2 and 3 5 <"),
    "comment": ("a<!-- <p> -->b<!DOCTYPE x><?php x ?>c<!-- open", "abc"),
    "references": ("&lt;b&gt; &amp;lt; &#65;&#x1F600;&nbsp;&nbsp;x &bogus; &#xD800; &", "<b> &lt; A😀 x &bogus; &#xD800; &"),
    "title is no text": ("<html><head><title>T</title></head><body>b</body></html>", "b"),
    "long article": (f"<body>out<article>{LONG}</article>out</body>", LONG.strip()),
    "short article": ("<body>out <article>in</article></body>", "out\nin"),
    "longest of two": (f"<main>short</main><article>{LONG}one</article><article>{LONG}first and one</article>", LONG + "first and one"),
    "article in chrome": (f"<div class=sidebar><article>{LONG}<nav>no</nav></article></div>out", LONG.strip()),
    "nested articles": (f"<article>{LONG}<article>inner</article>tail</article>", LONG.strip() + "\ninner\ntail"),
    "unclosed article": (f"<body>x<article>{LONG}", LONG.strip()),
    "self-closing div": ("<div class=ad />kept", "kept"),
    "capitals": ("<NAV>no</NAV><H2>Yes</H2>", "## Yes"),
}


def test_pages_by_rule(spark):
    rows = [(n, h, 1) for n, (h, _) in PAGES.items()] + [("plain", PAGES["plain"][0], 2)] * 2
    got = readable(spark.createDataFrame(rows, "name string, html string, text_ int"), "html").collect()
    assert len(got) == len(rows)
    assert {(r["name"], r["text"]) for r in got} == {(n, t) for n, (_, t) in PAGES.items()}
    assert readable(spark.createDataFrame([], "name string, html string"), "html").count() == 0


def test_a_very_long_page(spark):
    html = "<body>" + "<div class='x'>" * 50 + "".join(f"<p>line {i} &amp; more</p>" for i in range(20_000)) + "</div>" * 50
    text = readable(spark.createDataFrame([(1, html)], "n int, html string"), "html").first()["text"]
    assert text == "\n\n".join(f"line {i} & more" for i in range(20_000))


def test_pages_shuffle_once_by_page(spark):
    pages = spark.createDataFrame([(1, "x")], "n int, html string")
    plan = readable(pages, "html")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") >= 1 and plan.count("ENSURE_REQUIREMENTS") <= 1


@pytest.mark.parametrize(
    "said, means",
    [("&copy;&shy;&euro;", "©€"), ("&#0065;&#X41;", "AA"), ("&#1114112;&#99999999999999999999;", "&#1114112;&#99999999999999999999;"), ("&#xFFFFFFFF;", "&#xFFFFFFFF;"), ("a & b &amp", "a & b &amp"), ("&amp;amp;", "&amp;"), (None, None), ("", "")],
)
def test_references(spark, said, means):
    assert spark.createDataFrame([(said,)], "t string").select(markup.decoded(F.col("t"))).first()[0] == means


def test_snippets(spark):
    rows = [("<strong>a</strong>  b &amp; c", "a b & c"), ("x > y <open", "x y"), (" a b ", "a b"), (None, None)]
    got = spark.createDataFrame(rows, "t string, e string").select(markup.cleaned(F.col("t")), "e").collect()
    assert all(r[0] == r[1] for r in got)


def test_tasks_are_dealt_by_bytes_of_source(spark, monkeypatch):
    monkeypatch.setattr(R, "SHARE", 1000)
    pages = spark.createDataFrame([(i, f"<p>{'word ' * 100}{i}</p>") for i in range(40)], "id long, html string")
    held = R._tokens(pages, "html").groupBy(F.spark_partition_id()).count().collect()
    assert len(held) > 4 and sum(r[1] for r in held) == 120
    assert {r.id: r.text for r in R.readable(pages, "html").collect()} == {i: f"{'word ' * 100}{i}" for i in range(40)}
