"""Network and navigation events as streams; each has a batch twin with the same result."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..plans.lineage import shared_folder


def events(spark: SparkSession, sf_dir: str, name: str = "events", files_per_trigger: int | None = None) -> DataFrame:
    """The event table as a stream; ``ts`` becomes a timestamp, as watermarks need."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(_source(spark, sf_dir, name)).withColumn("ts", F.col("ts").cast("timestamp"))


def _source(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A path that the file stream source takes: the table's folder, or for a single file a glob that is just it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    single = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile()
    return f"{sf_dir}/{name}.parque[t]" if single else f"{sf_dir}/{name}.parquet"


def by_type(rows: DataFrame) -> DataFrame:
    """Events by type, in update or complete mode."""
    return rows.groupBy("event_type").agg(F.count("*").alias("n"))


def latest(rows: DataFrame, key: str = "user_id") -> DataFrame:
    """The last event of each key by time, then id: (key, event_id, event_type, value)."""
    return rows.groupBy(key).agg(F.max(F.struct("ts", "event_id", "event_type", "value")).alias("x")).select(key, "x.event_id", "x.event_type", "x.value")


def latest_by_navigation(rows: DataFrame, key: str = "url", navigation: str = "nav_id") -> DataFrame:
    """The last row of each key within each navigation: a late response is credited to its own navigation."""
    rest = [c for c in rows.columns if c not in (key, navigation, "ord")]
    return rows.groupBy(navigation, key).agg(F.max_by(F.struct(*rest), "ord").alias("x")).select(navigation, key, "x.*")


def quiet_sessions(rows: DataFrame, gap: str, late: str, key: str = "user_id") -> DataFrame:
    """Sessions that a gap without events ends, in append mode: the nearest thing to waiting until a page is quiet."""
    marked = rows.withWatermark("ts", late)
    return marked.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n")


def navigations(rows: DataFrame, page: str) -> DataFrame:
    """(page, urls): the distinct URLs of each page's navigation events (page, url, ord), in order of first occurrence."""
    first = rows.groupBy(page, "url").agg(F.min("ord").alias("ord"))
    return first.groupBy(page).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "url"))), lambda x: x["url"]).alias("urls"))


def run_to_end(stream: DataFrame, name: str, mode: str = "complete", provider: str | None = None) -> DataFrame:
    """Drain what is there now into a table in the shared folder and return it. In complete mode each micro-batch
    replaces the table, else it is added; progress is kept beside it. ``provider``: the state store it needs, if not the
    session's own."""
    spark = stream.sparkSession
    root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/table" if mode == "complete" else f"{root}/table/batch={number}")

    with state_store(spark, provider):
        running = for_each_batch(stream, store, f"{root}/progress", mode)
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/table").select(stream.columns)


@contextlib.contextmanager
def state_store(spark: SparkSession, provider: str | None):
    """Streams that start within have this state store; the session's setting is then what it was."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    if provider:
        spark.conf.set(key, provider)
    try:
        yield
    finally:
        if provider and before:
            spark.conf.set(key, before)
        elif provider:
            spark.conf.unset(key)


def for_each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"):
    """Hand every micro-batch to ``handle``, with progress kept in ``checkpoint``."""
    return stream.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Progress(StreamingQueryListener):
    """What the running streams of a session have done so far, by name or id: batches, rows in, rows that came too late,
    rows of state, and how they ended. ``with Progress(spark) as seen: ...; seen.table()``."""

    def __init__(self, spark: SparkSession):
        self.spark, self.seen = spark, {}

    def __enter__(self) -> Progress:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.streams.removeListener(self)

    def _of(self, event) -> dict:
        return self.seen.setdefault(str(event.runId), {"name": None, "batches": 0, "rows": 0, "late": 0, "state": 0, "ended": None})

    def onQueryStarted(self, event) -> None:
        self._of(event)["name"] = event.name or str(event.id)

    def onQueryProgress(self, event) -> None:
        now, held = event.progress, self._of(event.progress)
        held["name"] = held["name"] or now.name or str(now.id)
        held["batches"] += 1
        held["rows"] += now.numInputRows
        held["late"] += sum(x.numRowsDroppedByWatermark for x in now.stateOperators)
        held["state"] = sum(x.numRowsTotal for x in now.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._of(event)["ended"] = event.exception or "done"

    def table(self) -> DataFrame:
        """A row for each stream."""
        rows = [(run, *(v[k] for k in ("name", "batches", "rows", "late", "state", "ended"))) for run, v in self.seen.items()]
        return self.spark.createDataFrame(rows, "run string, name string, batches long, rows long, late long, state long, ended string")
