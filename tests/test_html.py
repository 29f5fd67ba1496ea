"""Pages as tokens: markup that is none, tags of any length, pages that end inside a tag."""

import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from graphwright.operators import links as L
from graphwright.sources.tables import table


def anchors(spark, *pages):
    rows = [(i, "https://en.wikipedia.org/wiki/Own", p) for i, p in enumerate(pages)]
    df = L.page_anchors(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {i: [] for i in range(len(pages))}
    for r in df.orderBy("page_id", "pos").collect():
        got[r.page_id].append((r.href, r.text))
    return [got[i] for i in range(len(pages))]


CASES = [  # page, its anchors
    ('<!-- <a href="/x">no</a> --><a href="/y">yes</a>', [("/y", "yes")]),
    ('<!--><a href="/y">yes</a><!-- open <a href="/x">no</a>', [("/y", "yes")]),
    ('<script>"<a href=/x>no</a>"</script><style>a<b{}</style ><a href=/y>yes</a>', [("/y", "yes")]),
    ('<SCRIPT src="a>b">if (a</b) "<a href=/x>"</scripts></ScRiPt ><a href=/y>yes</a>', [("/y", "yes")]),
    ('<scripts><a href=/y>yes</a></scripts>', [("/y", "yes")]),
    ('<title><a href=/x>no</a></title><textarea><a href=/x></textarea><a href=/y>yes', [("/y", "yes")]),
    ("<a title=it's href=/y>it's</a> and 'more'", [("/y", "it's")]),
    ('<a title="<a href=/x>" href="/y">y</a>', [("/y", "y")]),
    ("<a\n\thref\n=\n'/y'\n>line\nfeed</a\n>", [("/y", "line\nfeed")]),
    ("<a/href=/y/>y</a><a href=/z/ >z</a>", [("/y/", "y"), ("/z/", "z")]),
    ('<a href="/1">one<a href="/2">two</a>three</a>', [("/1", "one"), ("/2", "two")]),
    ('<a href="/1">one <b>two</b><br/>three <!-- no --> four', [("/1", "one twothree  four")]),
    ('1 < 2 <a href="/y">a < b &lt;c&gt; </ d>e</>f</a>', [("/y", "a < b <c> ef")]),
    ('<a href="/y" href="/x">first</a><a href>none</a><a href="">none</a><a href= >none</a>', [("/y", "first")]),
    ('<a =href=/x hrefs=/x data-href=/x xhref=/x>no</a><a = href=/y>y</a>', [("/y", "y")]),
    ('<abbr href=/x>no</abbr><a:b href=/x>no</a:b><A HREF=/y>y</A>', [("/y", "y")]),
    ('<!doctype html "><a href=/x>x</a><?php <a href=/n> ?><![CDATA[<a href=/n>y</a>]]>', [("/x", "x")]),
    ('<a href="/y">y</a><a href="/x', [("/y", "y")]),
    ('<a href="/y">y</a><a href=/x ', [("/y", "y")]),
    ("\u0001<a href=/y\u0002>y\u0001y</a>", [("/y", "yy")]),
    ("", []), ("<", []), ("<a", []), ("</a>", []), ("<a>", []), ("a", []),
]


def test_markup_and_what_is_none(spark):
    for (page, want), got in zip(CASES, anchors(spark, *(p for p, _ in CASES))):
        assert got == want, page


def test_null_pages_have_no_tags(spark):
    assert anchors(spark, None, "<a href=/y>y</a>") == [[], [("/y", "y")]]
    pages = spark.createDataFrame([(1, "u", None)], "page_id long, url string, html string")
    assert L.first_image(pages).count() == 0


@pytest.mark.parametrize("page, n", [
    ("<a " + "x" * 100_000 + ' href="/y">y</a>', 1),
    ("<a " + "x " * 500_000 + 'href="/y">y</a>', 1),
    ("<a " + "x " * 500_000, 0),
    ("<a x x x" * 130_000, 0),
    ('<a x="' * 160_000, 0),
    ("<a href=/" + "y" * 1_000_000 + ">y</a>", 1),
    ("<" * 1_000_000 + "<a href=/y>", 1),
    ("<!--" * 250_000, 0),
    ("<script>" * 120_000, 0),
    ("<script></script" * 60_000, 0),
    ("<a href='/y'>" + "<b c=d>e</b>" * 80_000 + "</a>", 1),
    ("<a href=/y>y</a>" * 60_000, 60_000),
    ('<img src="x' + "'" * 1_000_000, 0),
], ids=lambda v: None if isinstance(v, int) else v[:12])
def test_long_and_open_tags_take_linear_time(spark, page, n):
    start = time.time()
    df = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    assert L.page_anchors(df).count() == n and L.first_image(df).count() == 0
    assert time.time() - start < 20


class Reader(HTMLParser):
    """Anchors by the standard library's reader, ending as the operator's do."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.open = [], False

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.open = True
            self.found.append([next((v for k, v in attrs if k == "href"), "") or "", ""])

    def handle_endtag(self, tag):
        if tag == "a":
            self.open = False

    def handle_data(self, data):
        if self.open:
            self.found[-1][1] += data


def test_given_pages_equal_the_standard_reader(spark, sf_small):
    pages = table(spark, sf_small, "pages")
    got = {}
    for r in L.page_anchors(pages).orderBy("page_id", "pos").collect():
        got.setdefault(r.page_id, []).append([r.href, r.text])
    rows = pages.collect()
    assert len(rows) > 10
    for r in rows:
        reader = Reader()
        reader.feed(r.html)
        assert got.get(r.page_id, []) == [f for f in reader.found if f[0]], r.page_id


def test_link_tables_of_long_pages(spark):
    page = "<a " + "x " * 100_000 + 'href="/wiki/Y">y</a><a href="/wiki/Y">y</a><!--' + "<a href='/wiki/Z'>z</a>" * 1000 + "-->"
    df = spark.createDataFrame([(1, "https://en.wikipedia.org/wiki/Own", page)], "page_id long, url string, html string")
    links = L.page_links(L.page_anchors(df))
    assert [(r.wikilink, r.value) for r in links.collect()] == [("https://wikipedia.org/wiki/Y", "y")]
    assert L.link_foaf(links).where(F.col("o") == "y").count() == 1
