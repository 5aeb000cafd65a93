"""Line deduplication: drop every line whose key is found in many documents, keep the order of the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys commoner than this share of all (document, key) rows are broadcast: fewer than its inverse can be.
HOT_SHARE = 5_000


def line_key(line):
    """White space stripped at both ends, A-Z in lower case."""
    return F.translate(F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", ""), UPPER, LOWER)


def line_digest(line, min_chars: int):
    """16 bytes of the SHA-256 of a line's key; null if the key is too short to count."""
    key = line_key(line)
    return F.when(F.length(key) >= min_chars, F.substring(F.unhex(F.sha2(key, 256)), 1, 16))


def common_lines(docs: DataFrame, scratch: Scratch, min_docs: int, min_chars: int) -> DataFrame:
    """(doc_id, dropped): the digests that a document loses. ``docs``: doc_id, text."""
    held = docs.select("doc_id", F.explode(F.array_distinct(F.transform(F.split("text", "\n", -1), lambda x: line_digest(x, min_chars)))).alias("digest")).filter("digest is not null")
    held = scratch.keep(held.distinct(), "held")
    common = scratch.keep(held.groupBy("digest").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs), "common")
    total = held.count()
    hot = F.broadcast(common.filter(F.col("n") * HOT_SHARE > total).select("digest"))  # fewer than HOT_SHARE rows of 16 bytes
    rest = common.filter(F.col("n") * HOT_SHARE <= total).select("digest")
    found = held.join(hot, "digest", "left_semi").unionByName(held.join(hot, "digest", "left_anti").join(rest, "digest"))
    return scratch.keep(found.groupBy("doc_id").agg(F.collect_set(F.hex("digest")).alias("dropped")), "dropped")


def dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, text (the lines that stay, joined by \\n).

    A null or empty text is one empty line. Keys of fewer than ``min_chars`` code points never count. Rows that repeat a
    doc_id count as one document. A null doc_id counts as one document too. All lines of a document that lost every
    line give an empty text. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "line-dedup")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    dropped = common_lines(docs, scratch, min_docs, min_chars)
    # one shuffle of the texts by id; each document carries its own few digests
    both = docs.join(dropped.withColumnRenamed("doc_id", "_id").hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    lines = F.split("text", "\n", -1)
    kept = F.when(F.col("dropped").isNull(), lines).otherwise(
        F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col("dropped"), F.hex(line_digest(x, min_chars))), F.lit(False)))
    )
    both = both.select("doc_id", F.size(lines).cast("long").alias("n_lines"), kept.alias("kept"))
    return both.select("doc_id", "n_lines", (F.col("n_lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("text"))


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    done = dedup(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos, len(ls) AS n_lines FROM d),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, c.key IS NOT NULL AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, CAST(any_value(n_lines) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
