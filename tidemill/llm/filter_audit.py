"""Filter interaction audit: what each of several filters removes, in every order, from one histogram of failure masks.

Whether a text fails a filter is a bit, and the five bits of a document say all that any order of the filters can do to it:
the document goes at the first filter of the order whose bit is set. So documents are read once, by native expressions;
what follows works on 32 cells per part, however many documents there are.

1. Four bits come from the text itself; the fifth, "equal to the text of a smaller doc_id", from a groupBy on the text's
   SHA-256 and length, which supplies the smallest doc_id. Documents are counted by (text, part, labels, id) first, then by
   (text, part, labels), so copies are summed before they meet and a text with very many copies is a few rows.
2. Cells: documents, good ones and toxic ones by part and mask.
3. Orders and steps are a literal array of 600 rows; every count is a sum over the 32 cells of the part.

A document fails k filters; each of them is the first of the k in 120 / k of the 120 orders, which gives its Shapley share
without going through the orders.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

FILTERS = "ABCDE"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WHITE = r"[\x20\x09-\x0D]+"
#: The filter that only the table as a whole decides.
REPEATED = "E"


def text_mask(text: Column, min_words: int = 100, min_distinct: int = 80, max_upper: int = 10, symbols: str = r"[#$%&*|]") -> Column:
    """Bits 1, 2, 4, 8 of the filters A to D that ``text`` fails; a text without words fails A alone."""
    words = F.filter(F.split(text, WHITE, -1), lambda w: w != "")
    upper = F.length(text) - F.length(F.translate(text, UPPER, ""))
    fails = [
        F.size(words) < min_words,
        F.size(F.array_distinct(words)) * 100 < F.size(words) * min_distinct,
        upper * 100 > F.length(text) * max_upper,
        text.rlike(symbols),
    ]
    return sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(fails)), F.lit(0))


def marks(labels: DataFrame) -> DataFrame:
    """(doc_id, good, toxic): 1 where any row of the id says so. Rows without an id are no labels."""
    of = lambda name: F.coalesce(F.max(F.when(F.col(name) == 1, 1)), F.lit(0))
    return labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(of("quality").alias("good"), of("toxic").alias("toxic"))


def cells(docs: DataFrame, labels: DataFrame, part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and failure mask, of those the good and the toxic ones.

    ``docs``: doc_id, text and the part. A null text is empty, a null part the empty string. Rows that repeat an id each
    count; of equal texts, all rows of the smallest id pass filter E, and so do rows without an id, which come before
    none. Without rows there are no cells.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    seen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    seen = seen.select("doc_id", "part", text_mask(F.col("text")).alias("own"), F.unhex(F.sha2("text", 256)).alias("digest"), F.length("text").alias("size"))
    seen = seen.groupBy("doc_id", "part", "own", "digest", "size").agg(F.count("*").alias("n"))
    seen = seen.join(marks(labels), "doc_id", "left").na.fill(0, ["good", "toxic"])
    alike = ["digest", "size", "own", "part", "good", "toxic"]
    # of each text a row for each part and pair of labels: all rows, and those of the least id in it
    held = seen.groupBy(*alike).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"),
        F.min("doc_id").alias("doc_id"),
        F.min_by("n", "doc_id").alias("at_least"),
    )
    # a window of few rows: one for each part and pair of labels that a text has
    held = held.withColumn("first", F.min("doc_id").over(Window.partitionBy("digest", "size")))
    first = F.col("no_id") + F.when(F.col("doc_id") == F.col("first"), F.col("at_least")).otherwise(0)
    again = 1 << FILTERS.index(REPEATED)
    split = F.explode(F.array(F.struct(F.col("own").alias("mask"), first.alias("n")), F.struct((F.col("own") + again).alias("mask"), (F.col("n") - first).alias("n"))))
    held = held.select("part", "good", "toxic", split.alias("x")).select("part", "x.mask", "x.n", "good", "toxic").filter("n > 0")
    return held.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def audit(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, from ``cells``. A part has at most 2 ** len(filters) cells."""
    steps = []
    for order in permutations(filters):
        before = 0
        for k, name in enumerate(order, 1):
            steps.append({"filter_order": "".join(order), "step": k, "bit": 1 << filters.index(name), "before": before})
            before |= 1 << filters.index(name)
    rows = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order string, step int, bit int, before int>>")
    held = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    held = held.select("part", "cells", F.explode(rows).alias("s")).select("part", "cells", "s.*")

    def total(name: str, where) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + F.when(where(c["mask"]), c[name]).otherwise(F.lit(0).cast("long")))

    fails = lambda m: m.bitwiseAND(F.col("bit")) != 0
    gone = lambda m: m.bitwiseAND(F.col("before")) != 0
    orders = F.lit(factorial(len(filters)))
    share = F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + F.when(fails(c["mask"]), c["n"] * (orders / F.bit_count(c["mask"])).cast("long")).otherwise(F.lit(0).cast("long")))
    return held.select(
        "part", "filter_order", "step",
        total("n", lambda m: ~gone(m) & ~fails(m)).alias("kept"),
        total("n", lambda m: ~gone(m) & fails(m)).alias("removed"),
        total("n", lambda m: gone(m) & fails(m)).alias("redundant"),
        total("n", lambda m: m == F.col("bit")).alias("unique_fails"),
        total("good", lambda m: ~gone(m) & fails(m)).alias("good_lost"),
        total("toxic", lambda m: ~gone(m) & fails(m)).alias("toxic_lost"),
        share.alias("shapley"),
    )


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(cells(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")))


OP11_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
f AS (SELECT doc_id, part,
  len(words) < 100 AS a, 100 * len(list_distinct(words)) < 80 * len(words) AS b,
  100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
  coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, [a, b, c, d, e] AS fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM f LEFT JOIN l ON f.doc_id = l.doc_id GROUP BY ALL),
p(i) AS (VALUES (1), (2), (3), (4), (5)),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS ord FROM p a, p b, p c, p d, p e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT ord, i AS step, ord[i] AS mine, ord[1:i - 1] AS earlier FROM o, p),
x AS (SELECT part, ord, step, n, good, toxic, fails[mine] AS failing, len(list_filter(earlier, lambda j: fails[j])) > 0 AS gone,
  len(list_filter(fails, lambda y: y)) = 1 AND fails[mine] AS only_mine, mine FROM m, s),
y AS (SELECT part, ord, step, any_value(mine) AS mine,
  sum(CASE WHEN NOT gone AND NOT failing THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND failing THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN gone AND failing THEN n ELSE 0 END) AS redundant, sum(CASE WHEN only_mine THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN NOT gone AND failing THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND failing THEN toxic ELSE 0 END) AS toxic_lost
  FROM x GROUP BY part, ord, step)
SELECT part, array_to_string(list_transform(ord, lambda j: substr('ABCDE', j, 1)), '') AS filter_order, CAST(step AS INTEGER) AS step,
  CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, mine) AS BIGINT) AS shapley
FROM y
"""
