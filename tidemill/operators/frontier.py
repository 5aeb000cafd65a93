"""A frontier that lasts: level by level over captured links, with a budget for each host, stopped and resumed at will.

What is known and what links where are tables in the shared folder, bucketed by key. A level's candidates are brought
together by key once, to make each of them one row; that is the distribution the buckets have, so neither the known keys
nor the links are ever shuffled again, however many levels there are. A filter of known keys would save nothing on top:
candidates have to meet by key anyway.

A level is first written to a folder of its own, then added to what is known. A crawl that was interrupted goes on after
the last whole level; if that had not been added yet, it is.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls

NODE = "key string, url string, host string, depth int, parent string"


class Frontier:
    """``root``: a folder that driver and executors share. ``buckets`` must stay what it was when the crawl began."""

    def __init__(self, spark: SparkSession, root: str, per_host: int, max_depth: int, buckets: int | None = None):
        self.spark, self.root, self.per_host, self.max_depth = spark, root.rstrip("/"), per_host, max_depth
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        name = uuid.uuid4().hex
        self._known = self._bucketed(f"frontier_known_{name}", "known", NODE, "key")
        self._links = self._bucketed(f"frontier_links_{name}", "links", "src string, dst string", "src")

    def _bucketed(self, name: str, folder: str, schema: str, key: str) -> str:
        self.spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{self.root}/{folder}'")
        return name

    def _exists(self, folder: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def level(self, depth: int) -> DataFrame:
        return self.spark.read.schema(NODE).parquet(f"{self.root}/level/{depth}")

    def known(self) -> DataFrame:
        """(key, url, host, depth, parent) of all that is in the crawl."""
        return self.spark.table(self._known)

    def _spread(self, df: DataFrame, key: str) -> DataFrame:
        return df.repartition(self.buckets, key)

    def _store(self, level: DataFrame, depth: int) -> None:
        level.write.mode("overwrite").parquet(f"{self.root}/level/{depth}")
        self._add(depth)

    def _add(self, depth: int) -> None:
        self._spread(self.level(depth), "key").write.insertInto(self._known)

    def start(self, seeds: DataFrame, links: DataFrame) -> Frontier:
        """Begin with seeds (url), which no budget limits, and links (src, dst), both URLs; or take up a crawl that has begun in this folder."""
        if not self._exists("level/0"):
            key = lambda c: urls.frontier_key(F.col(c))
            self._spread(links.select(key("src").alias("src"), "dst").distinct(), "src").write.mode("overwrite").insertInto(self._links)
            first = seeds.select(key("url").alias("key"), "url").filter("key is not null").groupBy("key").agg(F.min("url").alias("url"))
            self._store(first.select("key", "url", urls.hostname(F.col("url")).alias("host"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent")), 0)
        return self

    def depth(self) -> int:
        """The last whole level."""
        depth = 0
        while self._exists(f"level/{depth + 1}"):
            depth += 1
        return depth

    def candidates(self, depth: int) -> DataFrame:
        """What the last level links to and is not known, each key once: its first URL and its first parent."""
        level = self._spread(self.level(depth - 1).select(F.col("key").alias("src"), "url"), "src")
        found = level.join(self.spark.table(self._links).hint("merge"), "src").select(urls.frontier_key(F.col("dst")).alias("key"), "dst", F.col("url").alias("from"))
        each = self._spread(found, "key").groupBy("key").agg(F.min("dst").alias("url"), F.min("from").alias("parent"))
        return each.join(self.known().select("key").hint("merge"), "key", "left_anti")

    def step(self) -> bool:
        """One level more; false if the crawl is over."""
        last = self.depth()
        if self.known().agg(F.max("depth")).first()[0] != last and not self.level(last).isEmpty():
            self._add(last)
        if last >= self.max_depth or self.level(last).isEmpty():
            return False
        found = self.candidates(last + 1).withColumn("host", urls.hostname(F.col("url")))
        # the first of each host as far as its budget goes; the constant bound is applied before the shuffle
        place = F.row_number().over(Window.partitionBy("host").orderBy("url", "key"))
        found = found.withColumn("place", place).filter(F.col("place") <= self.per_host)
        spent = self.known().filter("depth > 0").groupBy("host").agg(F.count("*").alias("spent"))
        found = found.join(spent, "host", "left").filter(F.col("place") <= self.per_host - F.coalesce("spent", F.lit(0)))
        self._store(found.select("key", "url", "host", F.lit(last + 1).alias("depth"), "parent"), last + 1)
        return True

    def run(self, levels: int | None = None) -> DataFrame:
        """Go on to the end, or for some levels; what is known then."""
        done = 0
        while (levels is None or done < levels) and self.step():
            done += 1
        return self.known()

    def close(self) -> None:
        """Forget the tables' names; the folder stays."""
        for name in (self._known, self._links):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
