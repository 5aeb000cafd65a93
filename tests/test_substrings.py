import random
import re

import pytest
from pyspark.sql import functions as F

from tidemill.operators import filters, globs, rewrite, robots, substrings


def frame(spark, name, values):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


@pytest.mark.parametrize("seed", [1, 2])
def test_containing_against_all_pairs(spark, seed):
    r = random.Random(seed)
    word = lambda n, letters: "".join(r.choice(letters) for _ in range(n))
    texts = [word(r.randint(0, 14), "abé/.") for _ in range(150)] + [None, "aaaaaaaaaa", "aaaaaaaaaa"]
    needles = [word(r.randint(0, 7), "abé/.") for _ in range(150)] + [None, "", "aaaa", "zzzz", "a" * 50]
    got = {tuple(x) for x in substrings.containing(frame(spark, "text", texts), frame(spark, "needle", needles)).collect()}
    assert got == {(n, t) for n in needles for t in texts if n and t is not None and n in t}


def test_containing_over_pages_never_pairs_all(spark, sf_dir):
    urls = [r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("url").collect()]
    needles = {u[i : i + 6] for u in urls for i in range(0, len(u) - 6, 5)} | {"://", "e"}
    found = substrings.containing(frame(spark, "text", urls), frame(spark, "needle", sorted(needles)))
    assert {tuple(x) for x in found.collect()} == {(n, u) for n in needles for u in urls if n in u}
    assert "CartesianProduct" not in found._jdf.queryExecution().toString()
    empty = frame(spark, "text", [])
    assert substrings.containing(empty, frame(spark, "needle", ["a"])).count() == 0 == substrings.containing(frame(spark, "text", ["a"]), frame(spark, "needle", [])).count()


def test_style_sheets_by_any_part_of_a_path(spark):
    files = frame(spark, "name", ["b12.css", "none.css", "x.js", ".css", "b12.css"])
    origins = spark.createDataFrame([("u1", "assets/ab12c/k.css", 2), ("u2", "assets/b12.css", 1), ("u3", "assets/b12.css", 5)], "url string, local_path string, ord int")
    assert sorted((r.name, r.url) for r in rewrite.contains_lookup(files, origins).collect()) == sorted([("b12.css", "u2"), ("b12.css", "u2"), ("none.css", None), ("x.js", None), (".css", None)], key=str)


def by_hand(glob, text):
    return re.fullmatch("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob), text, re.S) is not None


GLOBS = ["", "*", "?", "??*", "a", "a*", "*a", "a?c", "*.css", "(*", "a[b*", "+?", "{x}", "a.b", "a|b", "^a$", "a\\b", "**b**", "ab", "abc*", "abd*", "*é?", "#*", "a-b&&c~"]
TEXTS = ["", "a", "ab", "abc", "abcd", "abd/x", "a.b", "axb", "x.css", "xcss", "(x", "a[bc", "+x", "{x}", "a|b", "^a$", "a\\b", "éé1", "a\nb", "#1", "a-b&&c~", "a" * 300]


def test_one_pattern_of_many_globs(spark):
    rows = frame(spark, "text", TEXTS)
    for some in (GLOBS, GLOBS[4:], GLOBS[9:12], ["a.b"], ["a*", "ab*", "abc*"]):
        got = {r.text for r in rows.filter(filters.included(F.col("text"), some)).collect()}
        assert got == {t for t in TEXTS if any(by_hand(g, t) for g in some)}
    many = [f"https://h{i}.com/*/p{i % 7}?x" for i in range(1000)]
    urls = [f"https://h{i}.com/{'a' * (i % 3)}/p{i % 7}{'?' if i % 2 else ''}x" for i in range(0, 1200, 7)]
    kept = {r.text for r in frame(spark, "text", urls).filter(filters.included(F.col("text"), many)).collect()}
    assert kept == {u for u in urls if any(by_hand(g, u) for g in many)} and 0 < len(kept) < len(urls)
    assert len(globs.pattern([f"https://a.com/{i}*" for i in range(1000)])) < 8000
    nested = ["a" * i + "b" for i in range(1500)]
    assert frame(spark, "text", ["a" * 1400 + "b", "a" * 1501 + "b"]).filter(filters.included(F.col("text"), nested)).count() == 1
    with pytest.raises(ValueError):
        globs.pattern(["https://a.com/(*"], literal=False)
    assert frame(spark, "text", ["axb"]).filter(F.col("text").rlike(globs.pattern(["a.b"], literal=False))).count() == 1


def test_globs_as_a_table(spark, sf_dir):
    got = {tuple(x) for x in substrings.matches(frame(spark, "text", [*TEXTS, None]), frame(spark, "glob", [*GLOBS, None, "a*"])).collect()}
    assert got == {(g, t) for g in GLOBS for t in TEXTS if by_hand(g, t)}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    urls = [r.url for r in pages.collect()]
    many = sorted({re.sub(r"[aeiou]", "?", u, count=2) for u in urls} | {u[: len(u) // 2] + "*" for u in urls[::3]} | {f"*/x{i}(*" for i in range(1000)})
    kept = {r.url for r in substrings.matched(pages, "url", frame(spark, "glob", many)).collect()}
    assert kept == {u for u in urls if any(by_hand(g, u) for g in many)}
    assert substrings.matched(pages, "url", frame(spark, "glob", [])).count() == 0


def plainly(path, pattern):
    body = pattern[:-1] if pattern.endswith("$") else pattern
    return re.match("".join(".*" if c == "*" else re.escape(c) for c in body) + (r"\Z" if pattern.endswith("$") else ""), path, re.S) is not None


@pytest.mark.parametrize("ban_all", [False, True])
def test_robots_against_every_rule(spark, ban_all):
    r = random.Random(3)
    word = lambda n: "/" + "".join(r.choice("ab/*$[") for _ in range(r.randint(0, n)))
    rules = [(f"h{r.randint(0, 3)}", r.choice(["allow", "disallow", "disallow"]), r.choice([word(4), "", "/", "*", "$"])) for _ in range(60)]
    paths = [(f"h{r.randint(0, 4)}", word(6), i) for i in range(300)] + [("h1", None, 900), (None, "/a", 901), ("h1", "/a", 902), ("h1", "/a", 902)]
    got = robots.allowed(spark.createDataFrame(paths, "host string, path string, n int"), spark.createDataFrame(rules, "host string, kind string, pattern string"), ban_all)

    def verdict(host, path):
        if host is None or path is None:
            return True
        mine = [(k, p) for h, k, p in rules if h == host and p and plainly(path, p)]
        return any(k == "allow" for k, _ in mine) or not any(k == "disallow" and (ban_all or p != "/") for k, p in mine)

    assert sorted(map(str, ((x.host, x.path, x.n, x.allowed) for x in got.collect()))) == sorted(map(str, ((h, p, n, verdict(h, p)) for h, p, n in paths)))


def test_agents_in_a_row_are_one_section(spark):
    text = "Disallow: /first\nUser-agent: a\nUser-agent: b\nDisallow: /x\n\nUser-agent: c\nAllow: /y\nUser-agent: *\nDisallow: /z"
    files = spark.createDataFrame([("h", text)], "host string, content string")
    found = lambda agent, grouped: [r.pattern for r in robots.rules(files, agent, grouped=grouped).orderBy("pos").collect()]
    assert (found("a", True), found("b", True), found("c", True)) == (["/x", "/z"], ["/x", "/z"], ["/y", "/z"])
    assert (found("a", False), found("b", False)) == (["/z"], ["/x", "/z"])
