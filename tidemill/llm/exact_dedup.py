"""Exact deduplication against immutable snapshots.

A snapshot holds one row per distinct text it has seen: the digest of the normalised text, the smallest doc_id and the
number of rows, in digest buckets of bounded size, with a static binary-fuse filter per bucket. A batch is first grouped
by digest on its own (partial aggregation, so one text may hold any share of the rows), then its distinct digests are
screened bucket by bucket against the filters; only positives join the snapshot's exact rows. Texts of one digest are
then compared byte by byte through the smallest and the largest text of the group, which again combines before any
shuffle; a collision, should there ever be one, is regrouped by the texts themselves.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, only, table
from .textvec import U, mix

#: Distinct digests in a bucket, about.
BUCKET = 50_000
WHITE = r"[\x20\x09-\x0D]+"


def normalised(text_col: str = "text"):
    """The text with every run of white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), WHITE, " ")


class BinaryFuse:
    """A static 3-wise binary fuse filter with 8-bit fingerprints (Graf and Lemire, 2022), built by peeling in waves."""

    def __init__(self, seed: int, segment: int, count: int, prints: np.ndarray):
        self.seed, self.segment, self.count, self.prints = seed, segment, count, prints

    @staticmethod
    def _places(keys: np.ndarray, seed: int, segment: int, count: int) -> tuple[np.ndarray, np.ndarray]:
        h = mix(keys ^ mix(np.full(1, seed, U)))
        mask = U(segment - 1)
        first = ((h >> U(32)) * U(count * segment)) >> U(32)
        places = np.stack([first, (first + U(segment)) ^ ((h >> U(18)) & mask), (first + U(2 * segment)) ^ (h & mask)])
        return places.astype(np.int64), ((h ^ (h >> U(32))) & U(255)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse:
        keys = np.unique(keys.astype(U))
        n = len(keys)
        segment = 4 if n < 2 else min(1 << 18, 1 << int(np.floor(np.log(n) / np.log(3.33) + 2.25)))
        factor = 2.0 if n < 2 else max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(n))
        count = max(1, -(-round(n * factor) // segment) - 2)
        for seed in itertools.count(1):  # a few; the room grows until peeling succeeds
            if seed % 20 == 0:
                count += max(1, count // 8)
            places, prints = cls._places(keys, seed, segment, count)
            held = np.bincount(places.ravel(), minlength=(count + 2) * segment)
            owner = np.zeros(len(held), np.int64)
            for p in places:
                np.bitwise_xor.at(owner, p, np.arange(n))
            waves, left = [], n
            single = np.flatnonzero(held == 1)
            while len(single):
                key, at = np.unique(owner[single], return_index=True)
                waves.append((key, single[at]))
                left -= len(key)
                touched = places[:, key]
                for p in touched:
                    np.subtract.at(held, p, 1)
                    np.bitwise_xor.at(owner, p, key)
                single = np.unique(touched)
                single = single[held[single] == 1]
            if left == 0:
                out = np.zeros(len(held), np.uint8)
                for key, at in reversed(waves):
                    own = places[:, key]
                    out[at] = 0
                    out[at] = prints[key] ^ out[own[0]] ^ out[own[1]] ^ out[own[2]]
                return cls(seed, segment, count, out)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """True for every key of the set, and for about one other key in 256."""
        places, prints = self._places(keys.astype(U), self.seed, self.segment, self.count)
        return (self.prints[places[0]] ^ self.prints[places[1]] ^ self.prints[places[2]]) == prints


def _keys(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(d)[:8] for d in digests), U)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    f = BinaryFuse.build(_keys(pdf["digest"]))
    return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "seed": [f.seed], "segment": [f.segment], "count": [f.count], "prints": [f.prints.tobytes()]})


def _screen(batch: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    out = batch[["digest", "keep_id", "n"]].copy()
    out["maybe"] = False
    if len(filters) and len(batch):
        r = filters.iloc[0]
        out["maybe"] = BinaryFuse(int(r["seed"]), int(r["segment"]), int(r["count"]), np.frombuffer(r["prints"], np.uint8)).holds(_keys(batch["digest"]))
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the SHA-256 of the normalised text."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(text_col), 256)).alias("digest"))


def grouped(prints: DataFrame) -> DataFrame:
    return prints.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("digest"), F.lit(buckets)).alias("bucket")


class Snapshot:
    """An immutable set of seen texts: exact rows (digest, keep_id, n, bucket) and a filter for each bucket.

    It lives in a folder, which ``open`` reads again in a later session.
    """

    def __init__(self, rows: DataFrame, filters: DataFrame, buckets: int):
        self.rows, self.filters, self.buckets = rows, filters, buckets

    @classmethod
    def build(cls, prints: DataFrame, path: str) -> Snapshot:
        """Of fingerprints (doc_id, digest), written to ``path``."""
        spark = prints.sparkSession
        grouped(prints).write.mode("overwrite").parquet(f"{path}/rows")
        buckets = max(1, -(-spark.read.parquet(f"{path}/rows").count() // BUCKET))
        rows = spark.read.parquet(f"{path}/rows").withColumn("bucket", _bucket(buckets))
        filters = rows.select("bucket", "digest").groupBy("bucket").applyInPandas(_build, "bucket long, seed long, segment long, count long, prints binary")
        filters.withColumn("buckets", F.lit(buckets)).write.mode("overwrite").parquet(f"{path}/filters")
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Snapshot:
        filters = spark.read.parquet(f"{path}/filters")
        first = filters.select("buckets").first()
        buckets = first["buckets"] if first else 1
        return cls(spark.read.parquet(f"{path}/rows").withColumn("bucket", _bucket(buckets)), filters.drop("buckets"), buckets)

    def classes(self, batch: DataFrame) -> DataFrame:
        """All classes of the snapshot and of a batch's fingerprints: digest, keep_id, n.

        A batch of many more texts than the snapshot comes in slices of each bucket, which all get its filter.
        """
        scratch = Scratch(batch.sparkSession, "exact-dedup")
        new = scratch.keep(grouped(batch), "batch")
        many = max(1, -(-new.count() // (BUCKET * self.buckets)))
        new = new.withColumns({"bucket": _bucket(self.buckets), "slice": F.pmod(F.xxhash64("digest", F.lit(1)), F.lit(many))})
        filters = self.filters.withColumn("slice", F.explode(F.expr(f"sequence(0L, {many - 1}L)")))
        told = new.groupBy("bucket", "slice").cogroup(filters.groupBy("bucket", "slice")).applyInPandas(_screen, "digest binary, keep_id long, n long, maybe boolean")
        return self._merge(told)

    def _merge(self, told: DataFrame) -> DataFrame:
        scratch = Scratch(told.sparkSession, "exact-dedup")
        told = scratch.keep(told, "screened")
        mine = self.rows.select("digest", F.col("keep_id").alias("old_id"), F.col("n").alias("old_n"))
        hits = scratch.keep(told.filter("maybe").join(mine, "digest", "left"), "hits")
        fresh = told.filter("not maybe").select("digest", "keep_id", "n").unionByName(hits.filter("old_n is null").select("digest", "keep_id", "n"))
        known = self.rows.select("digest", "keep_id", "n").join(
            hits.filter("old_n is not null").select("digest", F.col("keep_id").alias("new_id"), F.col("n").alias("new_n")), "digest", "left"
        )
        known = known.select("digest", F.least("keep_id", "new_id").alias("keep_id"), (F.col("n") + F.coalesce("new_n", F.lit(0))).alias("n"))
        return fresh.unionByName(known)


def dedup(docs: DataFrame, in_snapshot, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``in_snapshot`` is a condition on ``docs``: its rows make the snapshot, the others are the incoming batch. Texts are
    equal when identical after white space runs became one space; null counts as empty. Of equal texts the smallest
    doc_id stays; rows that repeat that doc_id with the same text all stay; a null doc_id stays only if its whole group
    has none. Other columns are not read, whatever their names. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    docs = docs.withColumn("_old", F.coalesce(in_snapshot, F.lit(False)))
    prints = scratch.keep(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(text_col), 256)).alias("digest"), "_old"), "prints")
    classes = Snapshot.build(prints.filter("_old"), scratch.path("snapshot")).classes(prints.filter("not _old"))
    # one row a class meets the rows of the class: AQE splits a class that holds a large share of them
    told = scratch.keep(prints.join(classes, "digest").select("doc_id", "digest", "keep_id", F.col("n").alias("group_size")), "told")
    again = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    members = again.join(told.filter("group_size > 1").select("doc_id", "digest").distinct().hint("shuffle_hash"), "doc_id")
    # texts without an id are found by their digest
    nameless = again.filter("doc_id is null").select("_text", F.unhex(F.sha2(normalised("_text"), 256)).alias("digest"))
    nameless = nameless.join(classes.filter("n > 1").select("digest"), "digest", "left_semi").select("digest", normalised("_text").alias("t"))
    spread = members.select("digest", normalised("_text").alias("t")).unionByName(nameless).groupBy("digest").agg(F.min("t").alias("low"), F.max("t").alias("high"))
    differ = spread.filter("low <> high").select("digest")
    if differ.limit(1).count():
        told = _regrouped(docs, told, scratch.keep(differ, "collided"), id_col, text_col)
    return told.select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def _regrouped(docs: DataFrame, told: DataFrame, collided: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Classes by the texts themselves, for digests that different texts share."""
    mine = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(text_col).alias("t")).withColumn("digest", F.unhex(F.sha2("t", 256))).join(collided, "digest", "left_semi")
    by_text = mine.groupBy("digest", "t").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return told.join(collided, "digest", "left_anti").unionByName(mine.join(by_text, ["digest", "t"]).select("doc_id", "digest", "keep_id", "group_size"))


def halves(id_col: str = "doc_id"):
    """The older delivery of a table that does not tell deliveries apart: half of its rows by a hash of the id."""
    return F.pmod(F.xxhash64(F.col(id_col)), F.lit(2)) == 0


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"), halves())


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of equal texts the smallest doc_id stays. Rows without an id stay; rows that repeat an id stay or go
    together; a null text counts as empty; all columns stay, whatever their names."""
    return only(docs, dedup(docs, halves()).filter("kept and doc_id is not null").select("doc_id").distinct())


OP7_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
