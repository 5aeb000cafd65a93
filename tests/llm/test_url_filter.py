import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm import url_filter


def brute(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    raw = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(raw) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in raw)
    fit = [(len(h) + len(p), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2], best[3] if best else default


def test_edge_cases(spark):
    urls = [None, "", "no scheme", "http://", "http://COM", "http://com/", "https://a.EXAMPLE.com/en/x?y#z", "x://www.example.com/en/", "http://e.net/es/?a://b", "http://net?/es/", "http://anet/es/", "http://a.b.www.example.com/en/q", "http://com:80/", "http://ünet/es/", "http://.net/fr/"]
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)] + [(3, "http://com/", "x", 1), (None, "http://com/", None, None)], "page_id long, url string, host string, part int")
    got = sorted(map(str, url_filter.judge(pages, spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")).collect()))
    from pyspark.sql import Row

    make = Row("page_id", "host", "path", "rule", "verdict")
    assert got == sorted(str(make(r.page_id, *brute(r.url, url_filter.RULES))) for r in pages.collect())
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r.verdict for r in url_filter.judge(pages, rules, "block").collect()} == {"block"}
    assert url_filter.judge(pages.limit(0), rules).collect() == []


def test_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "RANGE", 7)
    urls = [f"http://{'hot.a.com' if i % 3 == 0 else f's{i % 17}.b{i % 5}.com'}/p{i % 4}/" for i in range(200)]
    rules = [("com", "/", "allow"), ("a.com", "/p1", "block"), ("hot.a.com", "/p1/", "allow"), ("b2.com", "", "block"), ("s3.b3.com", "/p3", "block"), ("b3.com", "/p3", "allow"), ("b3.com", "/p3", "block")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: tuple(r)[1:] for r in url_filter.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate(urls)}


host = st.lists(st.sampled_from(["a", "b", "com", "", "a\x01b"]), min_size=1, max_size=4).map(".".join)
path = st.text(alphabet="/ab", max_size=4)


@given(st.lists(st.tuples(host, path), max_size=12), st.lists(st.tuples(host, path, st.sampled_from(["allow", "block"])), max_size=8))
@settings(max_examples=300, deadline=None)
def test_sweep(urls, rules):
    got = url_filter.sweep(urls, rules)
    for (h, p), g in zip(urls, got):
        fit = [(len(rh) + len(rp), rh + rp, v) for rh, rp, v in rules if (h == rh or h.endswith("." + rh)) and p.startswith(rp)]
        if not fit:
            assert g is None
        else:
            n = max(f[0] for f in fit)
            assert g in {(r, v) for m, r, v in fit if m == n}
