"""Shared plumbing: durable scratch tables, connected components, and the documents view."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir. A session on one machine may do without: it gets a
    folder of its own; on a cluster that is an error, since no local folder is shared."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemill-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


class Scratch:
    """Tables written to the shared folder to cut lineage; they outlive any executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the stored table."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def keep_bucketed(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """``keep`` for rows of which each is large: stored by buckets of ``key``, so that grouping by it shuffles nothing."""
        table = f"scratch_{uuid.uuid4().hex}"
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.format("parquet").bucketBy(n, key).option("path", self.path(name)).saveAsTable(table)
        stored = self.spark.table(table)  # resolved, so its name is not needed any more; the folder stays
        self.spark.sql(f"DROP TABLE {table}")
        return stored

    def hold(self, df: DataFrame) -> DataFrame:
        """Compute ``df`` once and keep it on the executors' disks until ``unpersist``; what an executor takes with it
        is computed again. For tables that are read a few times and soon dropped, this saves writing them out."""
        df = df.persist(StorageLevel.DISK_ONLY)
        df.count()
        return df

    def drop(self, name: str) -> None:
        """Delete a table that no later plan reads."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: list[str], name: str) -> str:
    """``name``, made longer until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with numbers for names: functions over batches do not take every name that a column can have."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more, instead of at some later collection,
    and hand the driver's freed memory back to the system where the C library can."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
    spark.sparkContext._jvm.System.gc()


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a function over batches, that hands freed memory back to the system when its task ends. Workers are used
    again and wait with what they hold, and would else keep the most that any task before has needed."""

    def runs(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return runs


def only(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is in ``kept`` (one column, distinct), and those without an id."""
    some = docs.filter(F.col(id_col).isNotNull()).join(kept.hint("shuffle_hash"), id_col, "left_semi")
    return some.unionByName(docs.filter(F.col(id_col).isNull()))


def hash_split(modulus: int, column: str = "doc_id"):
    """crc32 of the id as text, modulo ``modulus``; a null id counts as remainder 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(modulus)), F.lit(0))


def components(edges: DataFrame, scratch: Scratch, most: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b), by alternating large-star and small-star rounds.

    Returns (node, component) for every node of an edge; component is the smallest node reachable. Edges stay
    distributed: each round is one aggregate and one join on the node, written to the shared folder. A node with very
    many edges meets a one-row minimum, which AQE's skew join splits. Self-loops and repeated edges are harmless.
    """
    spark = edges.sparkSession
    start = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    now = scratch.keep(start, "cc0")
    before = None
    for k in range(1, most + 1):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: neighbours above u hang on the smallest of u's neighbourhood
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.filter("m < u").select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        # small star: u and its neighbours below hang on the smallest of those
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(floor.select("u", F.col("m").alias("v"))).distinct()
        now = scratch.keep(small, f"cc{k}")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if k > 1:
            scratch.drop(f"cc{k - 1}")
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not converge")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
