"""Frontier expansion over captured links, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..plans.lineage import cut
from .dedup import first_by


def seed(spark: SparkSession, url: str) -> DataFrame:
    """The one row at depth 0."""
    return spark.createDataFrame([(url, 0, None)], "url string, depth int, parent string")


def frontier_first(rows: DataFrame) -> DataFrame:
    """Of (url, depth, parent, ord) with equal frontier keys the one with the least depth, then ord; with its key."""
    return first_by(rows.withColumn("key", urls.frontier_key(F.col("url"))), ["key"], F.struct("depth", "ord"))


def bfs(seeds: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """(node, depth, parent): what ``seeds`` (node) reach over ``edges`` (src, dst) in ``max_depth`` steps at most.

    Level-synchronous: a level joins the edges once and loses what is known by an anti-join; both are cut from their
    lineage in the cluster's checkpoint folder. The parent is the smallest source in the level above. Ends early with an
    empty level.
    """
    known = seeds.select("node", F.lit(0).alias("depth"), F.lit(None).cast(seeds.schema["node"].dataType).alias("parent")).distinct()
    known = level = cut(known)
    for depth in range(1, max_depth + 1):
        step = level.select(F.col("node").alias("src")).join(edges, "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        level = cut(step.join(known.select("node"), "node", "left_anti").select("node", F.lit(depth).alias("depth"), "parent"))
        if level.isEmpty():
            break
        known = known.unionByName(level)
    return known


def limited(nodes: DataFrame, most: int) -> DataFrame:
    """The first ``most`` nodes by depth, then by name: the page limit of a crawl."""
    return nodes.orderBy("depth", "node").limit(most)


def levels(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("depth").agg(F.count("*").alias("n"))


def by_priority(queue: DataFrame) -> DataFrame:
    """Rank in a queue: high priority first, then shallow, then by URL."""
    return queue.orderBy(F.desc("priority"), "depth", "url")


def ranked(queue: DataFrame) -> DataFrame:
    """The queue with ``place``, from 1: sorted in ranges, counted range by range, so that no task holds all rows."""
    rows = cut(by_priority(queue).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))  # one row a range
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("_part", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    return rows.join(sizes, "_part").withColumn("place", F.col("_at") - F.col("_first") + F.col("_before") + 1).drop("_part", "_at", "_first", "_before")


def retries(failed: DataFrame, most: int = 3) -> DataFrame:
    """Queue items (url, priority, retry) that may be tried again, with retry + 1 and priority - 1, at least 0."""
    return failed.filter(F.col("retry") < most).select("url", F.greatest(F.col("priority") - 1, F.lit(0)).alias("priority"), (F.col("retry") + 1).alias("retry"))


def add_many(new: DataFrame, visited: DataFrame, queued: DataFrame) -> DataFrame:
    """New rows (url, ...) whose frontier key neither ``visited`` nor ``queued`` (url) has, one for each key."""
    key = urls.frontier_key(F.col("url"))
    known = visited.select(key.alias("key")).unionByName(queued.select(key.alias("key"))).distinct()
    return new.withColumn("key", key).join(known, "key", "left_anti").groupBy("key").agg(F.min("url").alias("url"))


def queue_stats(queued: DataFrame, visited: DataFrame) -> DataFrame:
    """One row: queued, visited, total."""
    both = queued.select(F.lit(1).alias("q"), F.lit(0).alias("v")).unionByName(visited.select(F.lit(0).alias("q"), F.lit(1).alias("v")))
    return both.agg(F.coalesce(F.sum("q"), F.lit(0)).alias("queued"), F.coalesce(F.sum("v"), F.lit(0)).alias("visited"), F.count("*").alias("total"))
