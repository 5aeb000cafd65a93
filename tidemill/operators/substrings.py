"""Substring joins by an inverted index of q-grams, and globs as a table on top of it.

A text holds a string only if it holds each of the string's grams, so a string is looked up by one of them: the rarest in
the texts, which passes over grams that are everywhere. Texts that share it are candidates, and only they are compared. No
step pairs all texts with all strings; both sides of each join are keyed by a gram, and a gram that is common on the
texts' side after all is one that every text found through it must be compared for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Q = 4


def grams(text: Column, q: int | Column) -> Column:
    """The distinct substrings of ``q`` characters; none of a shorter text."""
    q = F.lit(q) if isinstance(q, int) else q
    starts = F.when(F.length(text) >= q, F.sequence(F.lit(1), F.length(text) - q + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, q)))


def index(texts: DataFrame, sizes: DataFrame) -> DataFrame:
    """(gram, text): every text by each of its grams of the ``sizes`` (q: at most Q values) that are asked for."""
    wanted = sizes.agg(F.sort_array(F.collect_set("q")).alias("qs"), F.lit(1).alias("one"))  # one row of Q numbers at most
    both = texts.select("text").distinct().withColumn("one", F.lit(1)).join(F.broadcast(wanted), "one")
    return both.select(F.explode(F.flatten(F.transform("qs", lambda q: grams(F.col("text"), q)))).alias("gram"), "text")


def candidates(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, text) of texts that hold the rarest gram of a name. wanted: name, gram; grams of one name may be of several sizes,
    of Q characters at most. A name with a gram that no text holds has no candidate."""
    held = index(texts, wanted.select(F.length("gram").alias("q")).distinct())
    often = held.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = wanted.join(often, "gram", "left").groupBy("name").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("x"))
    return rarest.filter("x.n > 0").select("name", F.col("x.gram").alias("gram")).join(held, "gram").select("name", "text")


def containing(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """(needle, text): each distinct needle with each distinct text that holds it, as a string comparison would find.

    ``texts``: text; ``needles``: needle. Nulls and empty needles find nothing. A needle of fewer than Q characters is a
    gram itself.
    """
    asked = needles.select(F.col("needle").cast("string").alias("needle")).filter("needle <> ''").distinct()
    named = asked.select(F.col("needle").alias("name"), F.explode(grams(F.col("needle"), F.least(F.length("needle"), F.lit(Q)))).alias("gram"))
    found = candidates(texts.select(F.col("text").cast("string").alias("text")), named)
    return found.filter(F.contains("text", F.col("name"))).select(F.col("name").alias("needle"), "text")


# -- globs ----------------------------------------------------------------------------------------------------------
def glob_pattern(glob: Column) -> Column:
    """A glob as a regular expression: * any text, ? any character; all others stand for themselves."""
    plain = F.regexp_replace(glob, r"([\\.\[\](){}+^|$])", r"\\$1")
    return F.concat(F.lit(r"(?s)\A"), F.replace(F.replace(plain, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit(r"\z"))


def matches(texts: DataFrame, globs: DataFrame) -> DataFrame:
    """(glob, text): each distinct glob with each distinct text that it matches. ``texts``: text; ``globs``: glob.

    A glob is looked up by the rarest gram of its fixed parts; only texts that hold it are matched. Globs without a fixed
    part (of * and ? alone) match by length, and are joined by it. Null globs match nothing, the empty one the empty text.
    """
    asked = globs.select(F.col("glob").cast("string").alias("glob")).filter("glob is not null").distinct()
    texts = texts.select(F.col("text").cast("string").alias("text")).filter("text is not null").distinct()
    parts = asked.select("glob", F.filter(F.split("glob", r"[*?]", -1), lambda p: p != "").alias("parts"))
    long = F.filter("parts", lambda p: F.length(p) >= Q)
    # without a part of Q characters, the longest are grams themselves
    size = F.array_max(F.transform("parts", lambda p: F.length(p)))
    found = F.when(F.size(long) > 0, F.flatten(F.transform(long, lambda p: grams(p, Q)))).otherwise(F.filter("parts", lambda p: F.length(p) == size))
    named = parts.filter(F.size("parts") > 0).select(F.col("glob").alias("name"), F.explode(F.array_distinct(found)).alias("gram"))
    hits = candidates(texts, named).filter(F.rlike("text", glob_pattern(F.col("name")))).select(F.col("name").alias("glob"), "text")
    # of * and ? alone: a text of that length, or with a * of that length and more
    bare = parts.filter(F.size("parts") == 0).select("glob", F.length(F.replace("glob", F.lit("*"), F.lit(""))).alias("n"), F.contains("glob", F.lit("*")).alias("open"))
    sized = texts.withColumn("n", F.length("text"))
    exact = bare.filter("not open").join(sized, "n").select("glob", "text")
    longest = sized.agg(F.max("n").alias("most"), F.lit(1).alias("one"))  # one row
    opened = bare.filter("open").withColumn("one", F.lit(1)).join(F.broadcast(longest), "one").filter("n <= most").select("glob", F.explode(F.sequence("n", "most")).alias("n"))
    return hits.unionByName(exact).unionByName(opened.join(sized, "n").select("glob", "text"))


def matched(rows: DataFrame, column: str, globs: DataFrame) -> DataFrame:
    """The rows whose ``column`` any of the globs matches. Without globs there are none."""
    found = matches(rows.select(F.col(column).alias("text")), globs).select(F.col("text").alias(column)).distinct()
    return rows.join(found, column, "left_semi")
