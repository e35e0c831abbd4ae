"""Literal pages: links, JSON-LD shapes, character references, and pages that are cut off or hostile."""

import time

import pytest
from pyspark.sql import functions as F

from leadlens.functions import html as H
from leadlens.operators import discover as D
from leadlens.operators import extract as T

PAGE = """<!DOCTYPE html><html><head><link rel="stylesheet" href="/style.css"><base target=x>
<script>document.write('<a href="/in-script">x</a>')</script><style>a[href="/css"]{}</style>
<!-- <a href="/in-comment">no</a> --></head><body>
<a href="/double">1</a><A HREF='/single'>2</A><a class=b href=/bare>3</a><a data-href="/no">4</a>
<a title="1 > 0" href = "rel/page?a=1&amp;b=2">5</a><area shape=rect href="//cdn.example.org/x"><a name="top">6</a>
<a href="#frag">7</a><a href="javascript:void(0)">8</a><a href="" title="e">9</a><a href="/caf&eacute;&#38;&#x26;">10</a><abbr href="/no">
<a href='/q"uote'>11</a><a href="/cut"""


def one(spark, html, *columns):
    return spark.createDataFrame([(html,)], "html string").select(*columns).first()


def test_links_of_a_literal_page(spark):
    df = spark.createDataFrame([(1, "https://h.example.com/dir/p.html", PAGE), (2, "https://x.y/", None), (3, "https://x.y/", "")], "page_id int, url string, html string")
    got = [(r.page_id, r.link) for r in D.html_links(df).orderBy("page_id", "pos").collect()]
    h = "https://h.example.com"
    assert got == [(1, x) for x in (f"{h}/double", f"{h}/single", f"{h}/bare", f"{h}/dir/rel/page?a=1&b=2", "https://cdn.example.org/x",
                                    f"{h}/café&&", f'{h}/q"uote')]


@pytest.mark.parametrize("body, want", [
    ('<script type="application/ld+json">{"articleBody": "x"}</script>', "x"),
    ("<script id=a type='application/ld+json'>{\"articleBody\": \"x\"}</script>", "x"),
    ("<SCRIPT TYPE=application/ld+json>[{\"@type\": \"Person\"}, {\"articleBody\": \"x\"}]</SCRIPT>", "x"),
    ('<script type="application/ld+json">{"@graph": [{"name": "n"}, {"articleBody": "x"}]}</script>', "x"),
    ('<script type="application/ld+json">[{"@graph": [{"articleBody": "x"}]}]</script>', "x"),
    ('<script type="application/ld+json">{"broken": </script><script type="application/ld+json">{"articleBody": "x"}</script>', "x"),
    ('<script type="application/ld+json">{"articleBody": "first"}</script><script type="application/ld+json">{"articleBody": "x"}</script>', "first"),
    ('<script type="application/ld+json">{"articleBody": null}</script><script type="application/ld+json">{"articleBody": "<p>a</p> b"}</script>', "<p>a</p> b"),
    ('<script type="text/javascript">{"articleBody": "x"}</script>', None), ('<!-- <script type="application/ld+json">{"articleBody": "x"}</script> -->', None),
    ('<script type="application/ld+json">{"articleBody": "x"}', "x"), ('<script type="application/ld+json">42</script>', None),
    ('<script type="application/ld+json">{"articleBody": 7}</script>', "7"), ("", None), (None, None),
])
def test_json_ld_shapes(spark, body, want):
    assert one(spark, body, T.json_ld_field("html", "articleBody").alias("x")).x == want


@pytest.mark.parametrize("text, want", [
    ("a &amp; b", "a & b"), ("&uuml;&Uuml;&szlig;&auml;", "üÜßä"), ("&#252;&#xFC;&#XfC;", "üüü"), ("&euro;&ndash;&bdquo;&hellip;", "€–„…"),
    ("&amp;lt;", "&lt;"), ("x&nbsp;y&#160;z", "x y z"), ("&unknown; & &; &#; &#x; R&D &copy", "&unknown; & &; &#; &#x; R&D &copy"), ("&#128512;", "😀"),
    ("&#0;&#55296;&#1114112;", "���"), ("&", "&"), ("", ""), (None, None), ("plain", "plain"), ("&&amp;&", "&&&"), ("&yuml;&times;&divide;", "ÿ×÷"),
])
def test_character_references(spark, text, want):
    assert one(spark, text, H.unescape("html").alias("x")).x == want


def test_references_in_paragraphs_and_titles(spark):
    page = "<html><title>M&uuml;ller &#8211; B&ouml;rse</title><p>Stra&szlig;e &amp; Weg&#46;</p>"
    r = one(spark, page, T.paragraph_text("html").alias("p"), T.text_of(F.regexp_extract("html", T.TITLE, 1)).alias("t"))
    assert (r.p, r.t) == ("Straße & Weg.", "Müller – Börse")


def test_hostile_pages_end(spark):
    bad = ["<a href=\"" * 2_000, "<" * 200_000, "<a " + "x=1 " * 50_000 + ">", "<script>" * 5_000, "&" * 100_000, "<!--" * 50_000, "<a href='" + "y" * 300_000]
    df = spark.createDataFrame([(i, "https://h.com/", b) for i, b in enumerate(bad)], "page_id int, url string, html string")
    start = time.monotonic()
    assert D.html_links(df).count() == 0
    assert df.select(T.json_ld_field("html", "x").alias("x"), T.paragraph_text("html").alias("p")).where("x is not null").count() == 0
    assert time.monotonic() - start < 120


def test_keyword_table_of_words_and_phrases(spark):
    words = [(f"word{i}",) for i in range(10_000)] + [("Rail  Freight",), ("güter-verkehr",), ("a b c",), ("...",), (None,), ("rail",)]
    keywords = spark.createDataFrame(words, "keyword string")
    texts = ["New rail freight terminal", "RAIL. Freight!", "railfreight", "word17 word9999 word10000", "Güter Verkehr", "a b, c", "a b d c", "", None]
    items = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], "item_id int, clean_text string, lead_score int, classifier_model string")
    got = {r.item_id: (r.matched_keywords, r.lead_score, r.classifier_model) for r in T.prefilter_by_table(items, keywords).collect()}
    no = ([], 0, "pre-filter")
    assert got == {0: (["Rail  Freight", "rail"], None, None), 1: (["Rail  Freight", "rail"], None, None), 2: no, 3: (["word17", "word9999"], None, None),
                   4: (["güter-verkehr"], None, None), 5: (["a b c"], None, None), 6: no, 7: no, 8: no}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:  # the same by a shuffled join, as for a table beyond the bound
        for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.set(name, "-1")
        hits = T.keyword_hits(items, keywords)
        assert "SortMergeJoin" in hits._jdf.queryExecution().executedPlan().toString()
        assert hits.count() == 8
    finally:
        for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.set(name, old)
