"""URLs, links, bodies and selectors that the tables do not hold, against plain Python."""

from __future__ import annotations

from urllib.parse import urljoin

import pytest
from gleanframe.functions import identity
from gleanframe.operators import extract
from gleanframe.plans.registry import ORACLE_SQL, QUERIES
from pyspark.sql import functions as F
from tests.oracle import compare

CANONICAL = {
    "http://A.b/p?b=2&a=1": "http://A.b/p?a=1&b=2", "http://a.b/p?c=": "http://a.b/p?c=", "http://a.b/p?a=1&a=0": "http://a.b/p?a=0&a=1", "http://a.b/p?a-b=1&a=2": "http://a.b/p?a=2&a-b=1",
    "http://a.b/p?x=~*": "http://a.b/p?x=~%2A", "http://a.b/p?x=%20+y": "http://a.b/p?x=++y", "http://u:p@a.b:8080/p?q=%C3%A9#f": "http://u:p@a.b:8080/p?q=%C3%A9", "http://a.b": "http://a.b",
    "http://a.b/p#x?y=1": "http://a.b/p", "http://a.b/p?": "http://a.b/p", "http://a.b/p?k=v=w": "http://a.b/p?k=v%3Dw", "http://a.b/p?x=é": "http://a.b/p?x=%C3%A9",
}
LINKS = ["https://c.d/e", "//c.d/e", "/p", "p", "../p", "../../../p", "./p", "?q=1", "#f", "", "a/b/../c", "mailto:x@y.z"]


def test_canonical_url(spark):
    rows = spark.createDataFrame([(u,) for u in CANONICAL], "url string").select("url", identity.canonical_url(F.col("url")).alias("c")).collect()
    assert {r.url: r.c for r in rows} == CANONICAL


def test_links_of_all_shapes(spark):
    page = """<A HREF='/one'>x</A><a class="k" href=/two>y</a> <a\n href = "/three?a=1&amp;b=&#38;&#x20AC;">z</a><a data-href="/no" name=n>w</a><abbr href="/no">v</abbr><a href="">u</a>"""
    found = spark.createDataFrame([(page,), (None,)], "html string").select(identity.links(F.col("html")).alias("l")).collect()
    assert found[0].l == ["/one", "/two", "/three?a=1&b=&€", ""] and found[1].l is None


def test_bodies_tell_requests_apart(spark):
    rows = spark.createDataFrame([(0, "k=1", None, None), (1, None, {"b": "2", "a": "1"}, None), (2, "", {"a": "1", "b": "2"}, {"x": "y"}), (3, None, None, {"x": "y"}), (4, None, {}, None)], "i int, data string, json map<string,string>, params map<string,string>")
    found = [r.b for r in rows.select("i", identity.request_body(F.col("data"), F.col("json"), F.col("params")).alias("b")).orderBy("i").collect()]
    assert found == ["k=1", '{"a": "1", "b": "2"}', '{"a": "1", "b": "2"}', '{"x": "y"}', ""]


ODD_LINKS = [
    "http://c.d/a/../b", "http://a.b/./x", "HTTP://c.d/X", "https://c.d/a/../b", "http:foo", "http:", "a//b", "/a//b/../c", "?", "#", "?#", " x", "\tx\ny ", " ", "///x", "//h", "//h?q", "x?y/../z", "x#y/../z",
    "a;b", "../../../../x", "..", "./", "a/./b/", "tel:1", "1:2", "a b", "", "/", "/..", "/../x", "a/..", "a/../", "é/ü?ß", "javascript:void(0)", "x:y/z",
]


@pytest.mark.parametrize("base", ["http://a.b/x/y/z.html", "http://a.b/x/?q=1", "http://a.b", "HTTPS://a.b/#f", "http://a.b/x//y/z?a=b#c"])
def test_join_url(spark, base):
    rows = spark.createDataFrame([(x,) for x in ODD_LINKS], "link string").select("link", identity.join_url(F.lit(base), F.col("link")).alias("u")).collect()
    assert {r.link: r.u for r in rows} == {x: urljoin(base, x) for x in ODD_LINKS}
    rows = spark.createDataFrame([(x,) for x in LINKS], "link string").select("link", identity.join_url(F.lit(base), F.col("link")).alias("u")).collect()
    assert {r.link: r.u for r in rows} == {x: urljoin(base, x) for x in LINKS}


def test_decode_text(spark):
    bodies = [("é".encode(), None, "é"), ("<meta charset=gbk>中".encode("gbk"), None, "<meta charset=gbk>中"), ("中".encode("gbk"), "gbk", "中"), (b"\xff", None, "�"), (None, None, None), (b"a", "no-such-codec", "a")]
    rows = spark.createDataFrame([(i, b, e) for i, (b, e, _) in enumerate(bodies)], "i int, body binary, forced string")
    found = rows.select("i", extract.decode_text(F.col("body"), F.col("forced")).alias("t")).orderBy("i").collect()
    assert [r.t for r in found] == [t for _, _, t in bodies]


def test_css(spark):
    page = '<div class="a b"><p id="x">one</p><p>two<img src="i.png"></p></div><p>three</p>'
    asked = {"div p::text": ["one", "two"], "p#x::text": ["one"], ".b > p::text": ["one", "two"], "img::attr(src)": ["i.png"], "p::text": ["one", "two", "three"], "h1::text": []}
    rows = spark.createDataFrame([(page,)], "html string").select(*(extract.css(F.col("html"), s).alias(f"c{i}") for i, s in enumerate(asked)))
    assert list(rows.first()) == list(asked.values())


def test_css_tests_and_groups(spark):
    page = "<ul><li data-k='a, b'>1<li class='x y'>2<b>!</b></ul><p>3"
    asked = {"li:first-child::text": ["1"], "li:nth-child(2)::text": ["2"], "li[data-k='a, b']::text": ["1"], "li[data-k$=b]::text": ["1"], "li[data-k], b::text": ["1", "!"], "ul *::text": ["1", "2", "!"], "li.x.y > b::text": ["!"]}
    rows = spark.createDataFrame([(page,)], "html string").select(*(extract.css(F.col("html"), s).alias(f"c{i}") for i, s in enumerate(asked)))
    assert list(rows.first()) == list(asked.values())


def test_xpath(spark):
    page = '<html><body><h1 class="x">Hello</h1><ul><li>1<li>2<b>!</b></ul><a href="/next">n</a><img src="i.png"></body></html>'
    asked = {
        '//h1[@class="x"]/text()': ["Hello"], "//a/@href": ["/next"], "//li[2]/text()": ["2"], "//li[2]//text()": ["2", "!"], "/html/body/a": ["n"], "/body/a": [],
        "//li | //img/@src": ["1", "2", "i.png"], "//@src": ["i.png"], '//*[contains(@class, "x")]/text()': ["Hello"], "//h1[@class]/text()": ["Hello"],
    }
    rows = spark.createDataFrame([(page,), (None,), ("",)], "html string").select(*(extract.xpath(F.col("html"), s).alias(f"c{i}") for i, s in enumerate(asked))).collect()
    assert list(rows[0]) == list(asked.values())
    assert set(rows[1]) == {None} and all(r == [] for r in rows[2])


def test_xpath_of_cut_and_other_references_equals_sql(spark, tmp_path):
    """Titles may end inside a reference; what SQL does not replace stays as it is written."""
    titles = ["a &amp;&amp", "t = &quot;5aa&quot", "x &amp;lt; &lt;b&gt; &am", "&#38; &copy; \U000f0000 &", ""]
    page = '<html lang="e&quot;n"><nav><ul><li><a href="/x?a=1&amp;b=2&quot;">x</a></li><li><a href="/y&lt">&amp;y&lt;</a></li></ul></nav><article><h1>{}</h1></article></html>'
    spark.createDataFrame([(i, page.format(t)) for i, t in enumerate(titles)], "page_id long, html string").coalesce(1).toPandas().to_parquet(tmp_path / "pages.parquet")
    compare(spark, str(tmp_path), "xpath_select", QUERIES["xpath_select"], ORACLE_SQL["xpath_select"])
    assert spark.createDataFrame([("<p>&quot;&copy",)], "html string").select(extract.xpath(F.col("html"), "//p")).first()[0] == ['"©']


@pytest.mark.parametrize("selector", ["a:hover", "a >", "> a", "a::before", "", ","])
def test_unknown_css_is_refused(selector):
    with pytest.raises(ValueError):
        extract.parse_selector(selector)


@pytest.mark.parametrize("path", ["//a[last()]", "a/b", "//a[@b][2]", "//div//@href", "", "//", "following::a"])
def test_unknown_xpath_is_refused(path):
    with pytest.raises(ValueError):
        extract.parse_xpath(path)


def test_table_name():
    assert identity.table_name("NewsItem") == "news"
    assert identity.table_name("ProductDetail") == "product_detail"
    assert identity.table_name("HTTPItem") == "h_t_t_p"


def test_decoding_stays_the_same_in_the_jvm(spark):
    """Bodies of all kinds as Python's codecs read them, whether they go there or not."""
    import re

    def slow(body, name):
        if body is None:
            return None
        found = re.search(rb"charset=[\"']?([A-Za-z0-9_-]+)", body[:2048])
        for codec in (name, "utf-8-sig" if body.startswith(b"\xef\xbb\xbf") else None, found and found[1].decode(), "utf-8"):
            try:
                if codec:
                    return body.decode(codec, "replace")
            except LookupError:
                continue

    page = '<meta charset="{}">naïve 中文'
    rows = [(b"plain", None), (None, None), (b"", None), ("é中😀".encode(), None), ("é".encode("latin-1"), None), ("é".encode("latin-1"), "latin-1"), ("é".encode(), "gbk"), ("é".encode(), ""), (b"\xef\xbb\xbfabc\xc3\xa9", None), (b"\xef\xbb\xbfabc\xff", None)]
    rows += [(page.format(c).encode(e, "replace"), None) for c, e in (("utf-8", "utf-8"), ("UTF8", "utf-8"), ("gbk", "gbk"), ("nonsense", "utf-8"), ("iso-8859-1", "latin-1"), ("utf-8", "latin-1"))]
    rows += [(b"x" * 2047 + "é charset=gbk".encode(), None), (b"\xed\xa0\x80", None), (b"\xf4\x90\x80\x80", None), (b"\xc0\x80", None)]
    table = spark.createDataFrame([(i, bytearray(b) if b is not None else None, e) for i, (b, e) in enumerate(rows)], "i int, body binary, e string")
    got = {r.i: r.t for r in table.select("i", extract.decode_text(F.col("body"), F.col("e")).alias("t")).collect()}
    assert got == {i: slow(b, e) for i, (b, e) in enumerate(rows)}


def test_named_entities(spark):
    import html

    texts = ["a&nbsp;b", "&eacute;&Eacute;&euro;", "&amp;lt;&lt;", "&nosuch;&amp;", "&#233;&#xE9;&apos;", "x?a=1&amp;copy=2", "&amp;amp;", ""]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(identity.unescape(F.col("t"))).collect()]
    assert got == [html.unescape(t) for t in texts]
