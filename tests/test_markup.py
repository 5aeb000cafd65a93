from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from tidemill.operators import extract, markup, rewrite

PAGE = "https://a.com/d/p.html"
# what a browser takes for links
PROBES = {
    "<style>x{} <a href=/s></style><a href='/1'>": ["/1"],
    "<textarea><a href=/t></textarea><a href=/1>": ["/1"],
    "<title><a href=/t></title><a href=/1>": ["/1"],
    "<script>'<a href=/s>'</script><A HREF=/1>": ["/1"],
    "<script>'</scripty><a href=/s>'</script ><a href=/1>": ["/1"],
    "<a href=/1><!-- open <a href=/z>": ["/1"],
    "<!--><a href=/1>--><a href=/2>": ["/1", "/2"],
    "<!---><a href=/1>": ["/1"],
    "<!-- a --!><a href=/1><!-- > <a href=/n> -->": ["/1"],
    "<!doctype html '><a href=/1>": ["/1"],
    "<? php <a href=/n> ?><a href=/1>": ["/1"],
    "</ <a href=/n>><a href=/1>": ["/1"],
    "</p href=/n><a href=/1>": ["/1"],
    "<div title='<a href=/n>'><a href=/1>": ["/1"],
    "<div title=x'><a href=/1>": ["/1"],
    '<div ="x><a href=/1>': ["/1"],
    "<a href=/1 / title=b='><a href=/2>": ["/1", "/2"],
    "<a href=\"/1\"title='>'><a\nhref = /2\n>": ["/1", "/2"],
    "<a href=/1><a href=\"/open <a href=/n>": ["/1"],
    "<a href=/1><a href=/n": ["/1"],
    "<abbr href=/n><a-b href=/n><a/href=/1>": ["/1"],
    "<a title=href=/n><a data-href=/n><a href=><a href><a href=/1&amp;2>": ["/1&2"],
    "a < b <a href=/1> <<a href=/2>": ["/1", "/2"],
    "<style><a href=/n>": [],
    "": [],
    None: [],
}


def test_links_as_browsers_see_them(spark):
    rows = spark.createDataFrame([(i, PAGE, h) for i, h in enumerate(PROBES)], "page_id int, url string, html string")
    got = {}
    for r in extract.hrefs(rows).orderBy("page_id", "pos").collect():
        got.setdefault(r.page_id, []).append(r.href)
    assert [got.get(i, []) for i in range(len(PROBES))] == list(PROBES.values())


class Links(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found = []

    def handle_starttag(self, tag, attrs):
        if tag == "a" and dict(attrs).get("href"):
            self.found.append(dict(attrs)["href"])


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_links_of_all_pages_against_a_parser(spark, sf):
    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
    got = {}
    for r in extract.hrefs(pages).orderBy("page_id", "pos").collect():
        got.setdefault(r.page_id, []).append(r.href)
    for r in pages.collect():
        parser = Links()
        parser.feed(r.html)
        assert got.get(r.page_id, []) == parser.found


def test_base(spark):
    bases = {
        "<a href=x>": "https://a.com/d/x", "<base href='https://b.com/k/'><a href=x>": "https://b.com/k/x", "<base target=_top><base href=/r/><base href=/n/><a href=x>": "https://a.com/r/x",
        "<!-- <base href=/n/> --><a href=x>": "https://a.com/d/x", "<base href='mailto:x'><a href=x>": "https://a.com/d/x", "<base href='https://b.com/'><a href=//c.com/y>": "https://c.com/y",
    }
    rows = spark.createDataFrame([(i, PAGE, h) for i, h in enumerate(bases)], "page_id int, url string, html string")
    got = {r.page_id: r.link for r in extract.links(rows, same_domain_only=False).collect()}
    assert [got[i] for i in range(len(bases))] == list(bases.values())
    asset = extract.page_assets(spark.createDataFrame([(1, PAGE, "<base href='/r/'><img src=i.png><style><img src=n.png></style>")], "page_id int, url string, html string"))
    assert [r.asset for r in asset.collect()] == ["https://a.com/r/i.png"]


def test_titles_and_raw_texts(spark):
    html = "<title>a &amp; <b>b</title><svg><title>c</title><style>d{}</style><style media=x>e{}</style>"
    r = spark.range(1).select(extract.title(F.lit(html)).alias("t"), markup.raw_texts(F.lit(html), "style").alias("s")).first()
    assert (r.t, r.s) == ("a & <b>bc", ["d{}", "e{}"])


def test_rewriting_keeps_off_raw_text_and_repeated_ids(spark):
    known = spark.createDataFrame([("https://a.com/a", "x")], "url string, local_path string")
    bodies = ["<a href='/a'>", "<a href='/b'><a href='/a'>", "<style><a href='/a'></style><textarea><a href='/a'>", "<script>'<a href=/a>'</script><!-- <a href='/a'>", "<a href='/a'>"]
    rows = spark.createDataFrame([(1, "https://a.com/", b) for b in bodies], "id int, url string, body string")
    got = [r.body for r in rewrite.html_attributes(rows, "a", "href", "page", known).collect()]
    assert sorted(got) == sorted(["<a href='x'>", "<a href='/b'><a href='x'>", bodies[2], bodies[3], "<a href='x'>"])
