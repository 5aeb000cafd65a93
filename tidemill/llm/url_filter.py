"""URL filters as a sort-merge range join.

The canonical key of a host is its labels in reverse order, each closed by a separator, so that a host and all of its
subdomains are one interval of keys. Urls are ordered by key and dealt in ranges of bounded size; a rule goes to every
range that its interval meets, which for the few rules above a range is its ancestors. Within a range one sweep over
both sorted sides keeps the stack of rules whose interval is open, nested by construction; a url looks among the stack's
path prefixes for the longest rule.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, table
from .line_dedup import LOWER, UPPER

SEP, TOP = "\x01", "\U0010ffff"
#: Urls in a range, about, and groups of ranges at most.
RANGE, GROUPS = 100_000, 2_048


def split_url(df: DataFrame, url_col: str) -> DataFrame:
    """``df`` with _host and _path."""
    u = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, u.substr(at + 3, F.length(u))).otherwise("")
    df = df.withColumn("_rest", rest).withColumn("_raw", F.regexp_extract("_rest", r"^[^/?#]*", 0))
    after = F.col("_rest").substr(F.length("_raw") + 1, F.length("_rest"))
    return df.withColumns({"_host": F.translate("_raw", UPPER, LOWER), "_path": F.regexp_extract(after, r"^[^?#]*", 0)}).drop("_rest", "_raw")


def canonical(host: str) -> str:
    return SEP.join(reversed(host.split("."))) + SEP


def _utf8(x: str) -> bytes:
    return x.encode("utf-8", "surrogatepass")


def sweep(urls: list[tuple[str, str]], rules: list[tuple[str, str, str]]) -> list[tuple[str, str] | None]:
    """For each (host, path) the (rule, verdict) of the longest rule that fits; rules: (host, path, verdict)."""
    out: list[tuple[str, str] | None] = [None] * len(urls)
    keyed = sorted((_utf8(canonical(h)), i) for i, (h, _) in enumerate(urls))
    by_host: dict[str, dict[str, str]] = {}
    for h, p, v in rules:
        paths = by_host.setdefault(h, {})
        paths[p] = "block" if "block" in (v, paths.get(p)) else v
    starts = sorted((_utf8(canonical(h)), h) for h in by_host)
    stack: list[tuple[bytes, str, list[int]]] = []  # open intervals, the widest first
    at = 0
    for key, i in keyed:
        while at < len(starts) and starts[at][0] <= key:
            begin, host = starts[at]
            while stack and not begin.startswith(stack[-1][0]):
                stack.pop()
            stack.append((begin, host, sorted({len(p) for p in by_host[host]}, reverse=True)))
            at += 1
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        host, path = urls[i]
        best = -1
        for _, h, sizes in reversed(stack):
            if host != h and not host.endswith("." + h):  # a separator within a host
                continue
            for n in sizes:
                if n <= len(path) and path[:n] in by_host[h]:
                    if len(h) + n > best:
                        best = len(h) + n
                        out[i] = (h + path[:n], by_host[h][path[:n]])
                    break
    return out


def _judge(urls: pd.DataFrame, rules: pd.DataFrame, default: str) -> pd.DataFrame:
    told = sweep(list(zip(urls["host"], urls["path"])), list(rules[["rule_host", "rule_path", "rule_verdict"]].itertuples(index=False, name=None)))
    out = urls[["page_id", "host", "path"]].copy()
    out["rule"] = [t[0] if t else None for t in told]
    out["verdict"] = [t[1] if t else default for t in told]
    return out


def _spread(rules: pd.DataFrame, bounds: pd.DataFrame) -> pd.DataFrame:
    """The rules with each of the ranges (part, low, high) that their intervals meet."""
    bounds = sorted((_utf8(b.low), _utf8(b.high), b.part) for b in bounds.itertuples())
    lows, highs = [b[0] for b in bounds], [b[1] for b in bounds]
    out = []
    for host, path, verdict in rules[["rule_host", "rule_path", "rule_verdict"]].itertuples(index=False, name=None):
        begin = _utf8(canonical(host))
        first, last = bisect.bisect_left(highs, begin), bisect.bisect_left(lows, begin + _utf8(TOP))
        out += [(b[2], host, path, verdict) for b in bounds[first:last]]
    return pd.DataFrame(out, columns=["part", "rule_host", "rule_path", "rule_verdict"])


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict.

    ``rules``: host, path, verdict ('allow' or 'block'). A rule fits its host and all subdomains where the url's path
    starts with the rule's; the longest (host and path together) wins, and of rules that differ only in the verdict
    'block'. A url without a rule, so also a null one, gets a null rule and ``default``. Rows with null fields in rules
    are no rules. Other columns of ``pages`` are not read, whatever their names.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "url-filter")
    urls = split_url(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("_url")), "_url")
    key = F.concat(F.array_join(F.reverse(F.split("_host", r"\.")), SEP), F.lit(SEP))
    urls = urls.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), key.alias("key"))
    count = pages.count()
    ranges = max(1, -(-count // RANGE))
    urls = urls.repartitionByRange(ranges, "key", "page_id", "path")  # the id cuts a hot host too
    urls = scratch.keep(urls.withColumn("part", F.spark_partition_id()), "urls")
    ranges = max(ranges, 1 + (urls.agg(F.max("part")).first()[0] or 0))
    bounds = urls.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    # rules go to groups of neighbouring ranges first, of which there are GROUPS at most, and from there to the ranges
    bounds = scratch.keep(bounds.withColumn("group", F.floor(F.col("part") / -(-ranges // GROUPS)).cast("int")), "bounds")
    wide = bounds.groupBy(F.col("group").alias("part")).agg(F.min("low").alias("low"), F.max("high").alias("high")).toPandas()
    named = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict")).dropna().distinct()
    kinds = "part int, rule_host string, rule_path string, rule_verdict string"
    near = named.mapInPandas(lambda it: (_spread(pdf, wide) for pdf in it), kinds).withColumnRenamed("part", "group")
    told = near.groupBy("group").cogroup(bounds.groupBy("group")).applyInPandas(_spread, kinds)
    both = urls.groupBy("part").cogroup(told.groupBy("part"))
    return both.applyInPandas(lambda a, b: _judge(a, b, default), "page_id long, host string, path string, rule string, verdict string")


#: The rules of the registered query.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


OP2_SQL = r"""
WITH r(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
m AS (SELECT p.page_id, max(struct_pack(n := length(r.host || r.path), rule := r.host || r.path, verdict := r.verdict)) AS best
  FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.page_id)
SELECT p.page_id, p.host, p.path, m.best.rule AS rule, coalesce(m.best.verdict, 'allow') AS verdict FROM p LEFT JOIN m ON p.page_id = m.page_id
"""
