"""First-wins and last-wins rules, by aggregates that combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(rows: DataFrame, keys: list[str], order: Column, last: bool = False) -> DataFrame:
    """One whole row per key: the first (or last) by ``order``, which should have no ties."""
    rest = [c for c in rows.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    return rows.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("_x")).select(*keys, "_x.*").select(rows.columns)


def canonical_paths(assets: DataFrame) -> DataFrame:
    """``assets`` (url, hash, local_path, ord, ...) with canonical_path and is_new: equal hashes share the first path.

    A null hash is no hash: such a row keeps its own path. The table of first rows has one row a hash, so a hash that
    many rows share meets a single row, which AQE's skew join splits.
    """
    first = assets.filter("hash is not null").groupBy("hash").agg(F.min(F.struct("ord", "local_path")).alias("_first"))
    both = assets.join(first, "hash", "left")
    return both.withColumn("canonical_path", F.coalesce("_first.local_path", "local_path")).withColumn("is_new", F.coalesce(F.col("_first.ord") == F.col("ord"), F.lit(True))).drop("_first").select(*assets.columns, "canonical_path", "is_new")


def add_results(adds: DataFrame) -> DataFrame:
    """What adding (url, hash, size, ord) in order returns: (ord, added), true for the first of a hash; false for a
    repeated URL."""
    urls = adds.groupBy("url").agg(F.min(F.struct("ord", "hash")).alias("u"))
    fresh = urls.groupBy("u.hash").agg(F.min("u.ord").alias("first_ord"))
    return adds.join(fresh.withColumnRenamed("hash", "_h"), F.col("hash") == F.col("_h"), "left").select("ord", F.coalesce(F.col("ord") == F.col("first_ord"), F.lit(False)).alias("added"))


def hash_groups(adds: DataFrame, most: int = 10_000) -> DataFrame:
    """(hash, part, urls): distinct URLs by hash, in order of the alphabet, ``most`` to a row. A hash that very many URLs share
    is many rows; it passes a sort, which spills, and is never gathered whole."""
    place = F.row_number().over(Window.partitionBy("hash").orderBy("url")) - 1
    placed = adds.select("hash", "url").distinct().withColumn("part", F.floor(place / most))
    return placed.groupBy("hash", "part").agg(F.sort_array(F.collect_list("url")).alias("urls"))


def stats(adds: DataFrame, saved_per_duplicate: int | None = None) -> DataFrame:
    """One row: unique_urls, unique_content, duplicates, total_bytes, saved_bytes of (url, hash, size, ord).

    Of a repeated URL the first row counts. ``saved_per_duplicate`` fixes what a duplicate saves; else it is the size
    of its content.
    """
    urls = adds.groupBy("url").agg(F.min(F.struct("ord", "hash", "size")).alias("u")).select("url", "u.*")
    by_hash = urls.groupBy("hash").agg(F.count("*").alias("n"), F.min(F.struct("ord", "size")).alias("f"))
    each = F.col("f.size") if saved_per_duplicate is None else F.lit(saved_per_duplicate)
    return by_hash.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("unique_urls"), F.count("*").alias("unique_content"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"),
        F.coalesce(F.sum("f.size"), F.lit(0)).alias("total_bytes"), F.coalesce(F.sum((F.col("n") - 1) * each), F.lit(0)).alias("saved_bytes"),
    )
