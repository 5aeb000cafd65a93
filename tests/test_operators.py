import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidemill import schemas
from tidemill.operators import crawl, filters, globs, manifest, rewrite, stats
from tidemill.plans import config
from tidemill.sources import captures
from tidemill.streaming import network


def test_entry_runs(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and df.columns == ["host", "pages", "links", "distinct_links", "internal"]


def test_oracle_names_are_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_works_without_the_llm_part(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/tidemill", tmp_path / "tidemill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') for q in e.queries() if q[2:3].isdigit()))"], cwd=tmp_path, capture_output=True, text=True)
    n, llm = out.stdout.split()[-2:]
    assert int(n) > 50 and llm == "False", out.stderr


def test_globs():
    assert globs.pattern(["https://a.com/*"]) == r"(?s)\A(?:https://a\.com/.*)\z" and globs.pattern(["/a?"], literal=False) == r"(?s)\A(?:(?:/a.))\z"


def test_config():
    c = config.CrawlConfig.of({"max_depth": None, "max_pages": 7}).with_include("*/en/*").with_asset_types("css")
    assert (c.max_depth, c.max_pages, c.include, c.asset_types) == (3, 7, ("*/en/*",), ("css",))
    assert config.cookies("a=1; b=x=y; =z;") == (("a", "1"), ("b", "x=y"))
    assert config.auth_of({"kind": "bearer", "token": "t"}).token == "t" and config.auth_of({"kind": "?"}).kind == "none"
    with pytest.raises(ValueError):
        config.CrawlConfig.of({"nope": 1})


def test_schemas(spark):
    assert spark.createDataFrame([], schemas.ASSET).columns[0] == "url"
    assert len(schemas.PAGE_URL) == 10 and len(schemas.ASSET_TYPES) == 9


def test_bfs_with_cycles_and_no_edges(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "a"), ("b", "c")], "src string, dst string")
    seeds = crawl.seed(spark, "a").select(F.col("url").alias("node"))
    got = {r.node: (r.depth, r.parent) for r in crawl.bfs(seeds, edges, 5).collect()}
    assert got == {"a": (0, None), "b": (1, "a"), "c": (2, "b")}
    assert crawl.bfs(seeds, edges.limit(0), 3).count() == 1


def test_rewrite_keeps_bodies_without_tokens(spark):
    table = spark.createDataFrame([("https://s.com/a", "x")], "url string, local_path string")
    df = spark.createDataFrame([(1, "https://s.com/", None), (2, "https://s.com/", ""), (3, "https://s.com/", "<a href='/a'><a href=\"/b\">")], "id int, url string, body string")
    got = {r.id: r.body for r in rewrite.html_attributes(df, "a", "href", "page", table).collect()}
    assert got == {1: None, 2: "", 3: "<a href='x'><a href=\"/b\">"}


def test_css_variants(spark):
    table = spark.createDataFrame([("https://s.com/a.png", "assets/img/h.png")], "url string, local_path string")
    df = spark.createDataFrame([(1, "https://s.com/", 'url(a.png) url("b.png")')], "id int, url string, body string")
    assert rewrite.css(df, table, mapped="root").first().body == 'url(assets/img/h.png) url("../assets/img/b.png")'
    assert rewrite.css(df, table, unmapped="keep").first().body == 'url(../img/h.png) url("b.png")'


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "css").mkdir()
    (tmp_path / "css" / "a.css").write_text("a{}")
    (tmp_path / "css" / "b.txt").write_text("no")
    assert [r.body for r in captures.style_sheets(spark, f"file://{tmp_path}/css").collect()] == ["a{}"]
    assert captures.assets(spark, f"file://{tmp_path}/css", "*.css").count() == 1
    rows = spark.createDataFrame([("u", "assets/css/h.css", True), ("v", "assets/css/h.css", False)], "url string, canonical_path string, is_new boolean")
    captures.write_assets(rows, f"file://{tmp_path}/out")
    assert [r.folder for r in spark.read.parquet(f"file://{tmp_path}/out").collect()] == ["css"]
    captures.write_manifest(spark.createDataFrame([("{}",)], "json string"), f"file://{tmp_path}/m")
    assert spark.read.text(f"file://{tmp_path}/m").first().value == "{}"
    files = spark.createDataFrame([("a", 200, "x"), ("b", 404, "y"), ("c", None, None)], "host string, status int, content string")
    assert {r.host for r in captures.robots(files).collect()} == {"a", "c"}
    captures.write_pages(rows, f"file://{tmp_path}/p")
    captures.write_rewritten(rows, f"file://{tmp_path}/q")
    assert captures.pages(spark, f"file://{tmp_path}/p").count() == 2


def test_progress_counters(spark):
    rows = spark.createDataFrame([(True,), (False,), (True,)], "ok boolean")
    pages, assets, seen, other = stats.progress(rows, rows.limit(1), "t")
    assert pages.count() == 3 and assets.count() == 1
    assert seen.get == {"total": 3, "succeeded": 2, "failed": 1} and other.get["total"] == 1


def test_manifest_collisions(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("b",)], "path string")
    assert [tuple(r) for r in manifest.collisions(rows).collect()] == [("a", 2)]


def test_streams(spark, sf_dir, tmp_path):
    batches = []
    q = network.for_each_batch(network.events(spark, sf_dir), lambda df, n: batches.append(df.count()), f"file://{tmp_path}/c")
    q.awaitTermination()
    assert sum(batches) == spark.read.parquet(f"{sf_dir}/events.parquet").count()
    day = datetime.datetime(2024, 1, 1)
    rows = [(day + datetime.timedelta(minutes=m), u) for m, u in ((0, 1), (1, 1), (30, 1), (0, 2))]
    got = network.quiet_sessions(spark.createDataFrame(rows, "ts timestamp, user_id long"), "5 minutes", "1 hour").collect()
    assert sorted((r.user_id, r.n) for r in got) == [(1, 1), (1, 2), (2, 1)]


def test_attributes_of_odd_tags(spark):
    from tidemill.operators import extract

    tags = [
        "<a href=/x>", "<a title='href=\"no\"' href = '/y'>", "<A HREF=\"/z?a=1&amp;b=2\" x>", "<a href>", "<a data-href=no>", "<a href=\"\">", "<a title=it's href=/q/r>", "<a/href=/s>", "<a \"stray\" href=/t>", "<a href='a > b'>",
    ]
    rows = spark.createDataFrame(list(enumerate(tags)), "i int, tag string")
    got = [r.v for r in rows.orderBy("i").select(extract.attribute(F.col("tag"), "href").alias("v")).collect()]
    assert got == ["/x", "/y", "/z?a=1&b=2", None, None, "", "/q/r", "/s", "/t", "a > b"]
    page = spark.createDataFrame([(1, "https://a.com/", "<a title='1 > 0' href=/x>t</a><!-- <a href=/no> --><script>'<a href=/no>'</script>")], "page_id int, url string, html string")
    assert [r.href for r in extract.hrefs(page).collect()] == ["/x"]


def test_robots_patterns_are_literal(spark):
    from tidemill.operators import robots

    rows = [("/a[b", "/a[bc", True), ("/a[b", "/ab", False), ("/x.y", "/xzy", False), ("/p(*)$", "/p(q)", True), ("/p(*)$", "/p(q)r", False), ("/$a", "/$a", True), ("/\\E", "/\\E1", True), ("/*", "/", True)]
    df = spark.createDataFrame(rows, "pattern string, path string, want boolean")
    assert all(r.want == r.got for r in df.select("want", robots.path_matches(F.col("path"), F.col("pattern")).alias("got")).collect())


def test_limits_ranks_and_routes(spark):
    from tidemill.operators import assets, extract

    rows = spark.createDataFrame([("css", 3), ("js", 1), ("image", 2), ("css", 4)], "type string, ord int")
    assert [r.ord for r in assets.limited(rows, 3, ["css", "js"], stored=1).collect()] == [1, 3]
    assert assets.limited(rows, 3, stored=5).count() == 0
    queue = spark.createDataFrame([(f"u{i:03}", i % 7, i % 3) for i in range(200)], "url string, depth int, priority int")
    want = sorted(((f"u{i:03}", i % 7, i % 3) for i in range(200)), key=lambda r: (-r[2], r[1], r[0]))
    got = {r.url: r.place for r in crawl.ranked(queue.repartition(5)).collect()}
    assert got == {r[0]: i for i, r in enumerate(want, 1)}
    links = spark.createDataFrame([(1, "a"), (1, None), (2, "b")], "page_id int, link string")
    routes = spark.createDataFrame([(1, "a"), (1, "c")], "page_id int, url string")
    assert {tuple(r) for r in extract.links_and_routes(links, routes).collect()} == {(1, "a"), (1, "c"), (2, "b")}
