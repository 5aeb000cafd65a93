import random
import shutil

from pyspark.sql import functions as F

from tidemill.functions import urls
from tidemill.operators import extract
from tidemill.operators.frontier import Frontier

LINKS = "src string, dst string"


def key(url):
    return url.split("?")[0].split("#")[0].removesuffix("/").lower()


def by_hand(seeds, links, per_host, depth):
    host = lambda u: u.split("/")[2].lower()
    known, spent = {}, {}
    for s in sorted(seeds):
        known.setdefault(key(s), (s, 0, None))
    level = [known[k] for k in known]
    for d in range(1, depth + 1):
        found = {}
        for url, _, _ in level:
            for src, dst in links:
                if key(src) == key(url) and key(dst) not in known:
                    a, b = found.get(key(dst), (dst, url))
                    found[key(dst)] = (min(a, dst), min(b, url))
        level = []
        for k, (url, parent) in sorted(found.items(), key=lambda x: (x[1][0], x[0])):
            if spent.get(host(url), 0) < per_host:
                spent[host(url)] = spent.get(host(url), 0) + 1
                known[k] = (url, d, parent)
                level.append(known[k])
    return {(k, *v) for k, v in known.items()}


def graph(seed):
    r = random.Random(seed)
    nodes = [f"https://h{r.randint(0, 3)}.com/P{i}" for i in range(60)]
    links = [(r.choice(nodes) + r.choice(["", "/", "#x"]), r.choice(nodes) + r.choice(["", "?q=1", "/"])) for _ in range(200)]
    return nodes[:3], links


def rows(df):
    return {(r.key, r.url, r.depth, r.parent) for r in df.collect()}


def test_one_run_and_a_stopped_one(spark, tmp_path):
    seeds, links = graph(1)
    first, edges = spark.createDataFrame([(s,) for s in seeds], "url string"), spark.createDataFrame(links, LINKS)
    whole = Frontier(spark, str(tmp_path / "a"), 9, 4, 4).start(first, edges)
    want = by_hand(seeds, links, 9, 4)
    assert rows(whole.run()) == want and len(want) > 20
    # neither what is known nor the links are shuffled for a level
    plan = whole.candidates(2)._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("\n") if "FileScan" in x and "Bucketed: true" in x]
    assert len(scans) == 2 and plan.count("Exchange") == 2
    stopped = Frontier(spark, str(tmp_path / "b"), 9, 4, 4).start(first, edges)
    stopped.run(2)
    stopped.close()
    # interrupted between storing a level and adding it
    again = Frontier(spark, str(tmp_path / "b"), 9, 4, 4).start(first, edges)
    again._add = lambda depth: None
    again.step()
    again.close()
    # interrupted while a level is written
    (tmp_path / "b/level/4").mkdir()
    (tmp_path / "b/level/4/part-0.parquet").write_text("half")
    resumed = Frontier(spark, str(tmp_path / "b"), 9, 4, 4).start(first, edges)
    assert rows(resumed.run()) == want
    shutil.rmtree(tmp_path / "b")


def test_budgets_and_empty_tables(spark, tmp_path):
    seeds, links = graph(2)
    first, edges = spark.createDataFrame([(s,) for s in seeds], "url string"), spark.createDataFrame(links, LINKS)
    small = Frontier(spark, str(tmp_path / "a"), 2, 6, 3).start(first, edges)
    assert rows(small.run()) == by_hand(seeds, links, 2, 6)
    none = Frontier(spark, str(tmp_path / "b"), 2, 6, 3).start(first.limit(0), edges)
    assert rows(none.run()) == set() and none.step() is False
    alone = Frontier(spark, str(tmp_path / "c"), 2, 6, 3).start(first, edges.limit(0))
    assert {r[0] for r in rows(alone.run())} == {key(s) for s in seeds}


def test_over_the_links_of_pages(spark, sf_dir, tmp_path):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    links = extract.links(pages, same_domain_only=False).select(F.col("url").alias("src"), F.col("link").alias("dst"))
    both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    seeds = pages.groupBy(urls.hostname(F.col("url"))).agg(F.min("url").alias("url")).select("url")
    got = rows(Frontier(spark, str(tmp_path / "p"), 5, 3, 4).start(seeds, both).run())
    assert got == by_hand([r.url for r in seeds.collect()], [tuple(r) for r in both.distinct().collect()], 5, 3)
