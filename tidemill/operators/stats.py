"""Crawl, storage and network statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def crawl_stats(pages: DataFrame, assets: DataFrame, distinct_assets: bool = True) -> DataFrame:
    """One row over pages (ok, bytes) and assets (url, ok, bytes): totals, successes, failures and bytes.

    Assets that several pages share count once unless ``distinct_assets`` is false; repeats then count as successes of
    no bytes.
    """
    if distinct_assets:
        assets = assets.groupBy("url").agg(F.max("ok").alias("ok"), F.max("bytes").alias("bytes"))
    row = lambda df, p: df.agg(
        F.count("*").alias(f"{p}_total"), F.count_if(F.col("ok")).alias(f"{p}_succeeded"), F.count_if(~F.col("ok")).alias(f"{p}_failed"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("bytes"))), F.lit(0)).alias(f"{p}_bytes")
    )
    both = row(pages, "pages").withColumn("_j", F.lit(1)).join(row(assets, "assets").withColumn("_j", F.lit(1)), "_j").drop("_j")  # one row each
    return both.withColumn("total_bytes", F.col("pages_bytes") + F.col("assets_bytes"))


def storage_stats(stored: DataFrame) -> DataFrame:
    """One row over stored assets (hash, size, is_new): files_created, total_size, duplicates_skipped."""
    return stored.agg(F.count_if("is_new").alias("files_created"), F.coalesce(F.sum(F.when(F.col("is_new"), F.col("size"))), F.lit(0)).alias("total_size"), F.count_if(~F.col("is_new")).alias("duplicates_skipped"))


def events_by_type(events: DataFrame, kind: str = "event_type") -> DataFrame:
    return events.groupBy(kind).agg(F.count("*").alias("n"))


def network_stats(requests: DataFrame, responses: DataFrame, assets: DataFrame) -> DataFrame:
    """One row: distinct request ids, response ids, asset URLs and seen URLs."""
    each = [df.select(F.lit(k).alias("k"), F.col(c).cast("string").alias("v")) for k, df, c in (("requests", requests, "id"), ("responses", responses, "id"), ("assets", assets, "url"), ("seen", responses, "url"))]
    rows = each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3]).distinct()
    return rows.agg(*(F.count_if(F.col("k") == k).alias(k) for k in ("requests", "responses", "assets", "seen")))


def progress(pages: DataFrame, assets: DataFrame, name: str = "progress"):
    """Frames that count themselves while they run, and the observations that then hold the counters."""
    from pyspark.sql import Observation

    seen = [Observation(f"{name}_pages"), Observation(f"{name}_assets")]
    watched = [df.observe(o, F.count("*").alias("total"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed")) for df, o in zip((pages, assets), seen)]
    return (*watched, *seen)


def open_path(pages: DataFrame) -> DataFrame:
    """(path): the first stored path that ends in index.html, else the first. pages: path, ord."""
    return pages.orderBy(F.desc(F.col("path").endswith("index.html")), "ord").select("path").limit(1)
