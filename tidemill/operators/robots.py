"""robots.txt: rules of a host's file, and which paths they allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rules(files: DataFrame, agent: str = "*", lower_case: bool = True, grouped: bool = True) -> DataFrame:
    """(host, kind, pattern, pos) of the lines that hold for ``agent`` in (host, content).

    User-agent lines in a row name the agents of one section; with ``grouped`` false the last of them counts alone.
    Sections for * and for the agent add up. Values are lower-cased unless ``lower_case`` is false.
    """
    lines = files.select("host", F.posexplode(F.split("content", "\n", -1)).alias("pos", "line")).withColumn("line", F.trim(F.regexp_replace("line", r"[\r\t]", " ")))
    lines = lines.filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    value = F.trim(F.regexp_replace("line", "^[^:]*:?", ""))
    key = F.lower(F.regexp_extract("line", "^([^:]*)", 1))
    lines = lines.select("host", "pos", key.alias("kind"), (F.lower(value) if lower_case else value).alias("pattern"))
    named = F.col("kind") == "user-agent"
    mine = named & F.lower("pattern").isin("*", agent.lower())
    # one robots file is one small group: its own lines
    w = Window.partitionBy("host").orderBy("pos")
    begins = named & (~F.coalesce(F.lag(named).over(w), F.lit(False)) if grouped else F.lit(True))
    told = lines.withColumns({"mine": mine, "begins": begins}).withColumn("section", F.sum(F.col("begins").cast("int")).over(w))
    told = told.withColumn("mine", F.max("mine").over(Window.partitionBy("host", "section")) & (F.col("section") > 0))
    return told.filter(F.col("mine") & F.col("kind").isin("allow", "disallow")).select("host", "kind", "pattern", F.col("pos").cast("int").alias("pos"))


def path_matches(path: Column, pattern: Column) -> Column:
    """* is any text and a final $ the end; all other characters stand for themselves; without $ a prefix is enough."""
    plain = F.regexp_replace(F.regexp_replace(pattern, r"\$$", ""), r"([\\.\[\](){}+?^|$])", r"\\$1")
    return F.rlike(path, F.concat(F.lit("(?s)^"), F.replace(plain, F.lit("*"), F.lit(".*")), F.when(pattern.endswith("$"), r"\z").otherwise("")))


def verdicts(asked: DataFrame, found: DataFrame) -> DataFrame:
    """(host, path, kind, pattern): the rules that match each distinct (host, path) of ``asked``.

    What a pattern begins with, up to its first wildcard, must begin the path. So a path meets its host's rules by equality
    of such beginnings, cut at the few lengths that the host's rules have; a rule without wildcard has then matched, and
    only the others are tried as patterns. Rules are never gathered by host, nor paths compared with all of them.
    """
    asked = asked.select("host", "path").filter("host is not null and path is not null").distinct()
    given = found.select("host", "kind", "pattern").filter("pattern <> ''").distinct()
    given = given.withColumn("head", F.regexp_replace(F.regexp_replace("pattern", r"\$$", ""), r"(?s)\*.*$", "")).withColumn("size", F.length("head"))
    sizes = given.groupBy("host").agg(F.collect_set("size").alias("sizes"))  # fewer than the longest pattern has characters
    cut = asked.join(sizes, "host").select("host", "path", F.explode(F.filter("sizes", lambda n: n <= F.length("path"))).alias("size"))
    met = cut.withColumn("head", F.substr("path", F.lit(1), F.col("size"))).join(given, ["host", "head", "size"])
    plain = F.col("pattern") == F.col("head")
    return met.filter(F.when(plain, True).otherwise(path_matches(F.col("path"), F.col("pattern")))).select("host", "path", "kind", "pattern")


def allowed(paths: DataFrame, found: DataFrame, ban_all: bool = False) -> DataFrame:
    """``paths`` (host, path, ...) with ``allowed``: false if a disallow matches and no allow does; true without rules,
    and for rows without host or path.

    Empty disallows never match. ``Disallow: /`` is skipped too unless ``ban_all``.
    """
    hits = verdicts(paths, found)
    denies = (F.col("kind") == "disallow") & (F.lit(ban_all) | (F.col("pattern") != "/"))
    told = hits.groupBy("host", "path").agg((~F.max(denies) | F.max(F.col("kind") == "allow")).alias("allowed"))
    return paths.join(told, ["host", "path"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(True)))
