"""Requests and responses as two event-time streams that meet in a join of bounded state, and late rows in a table of their own.

Both sides carry a watermark, and the join says how long after its request a response counts. So Spark knows when a request
can find no further response: it is given out as unanswered and leaves the state, as do responses that no request can ask
for any more. The state holds what came in during ``timeout`` and the watermark's delay, however long the stream runs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import filters
from ..plans.lineage import shared_folder
from .network import for_each_batch


def requests(rows: DataFrame, is_request: Column, key: str, id_col: str = "event_id") -> DataFrame:
    """(request_id, asked_key, asked_at) of the rows that ask."""
    return rows.filter(is_request).select(F.col(id_col).alias("request_id"), F.col(key).alias("asked_key"), F.col("ts").alias("asked_at"))


def responses(rows: DataFrame, is_response: Column, key: str, kind: Column, status: Column, body: Column, id_col: str = "event_id") -> DataFrame:
    """(response_id, key, answered_at, kind, status, body) of the rows that answer; bodies only of the kinds that are kept."""
    found = rows.filter(is_response).select(F.col(id_col).alias("response_id"), F.col(key).alias("answered_key"), F.col("ts").alias("answered_at"), kind.alias("kind"), status.alias("status"), body.alias("body"))
    return found.withColumn("body", F.when(filters.should_capture_body(F.col("kind"), F.col("status")), F.col("body")))


def exchanges(asked: DataFrame, answered: DataFrame, timeout: str, late: str) -> DataFrame:
    """A row for each request and response of one key at most ``timeout`` apart, and one for each request without any.

    The same plan runs over streams and over tables. As a stream (append mode) it gives out a request without response
    when the watermark, ``late`` behind the slower side, has passed its timeout. Rows without a key or time find nothing.
    """
    asked, answered = asked.withWatermark("asked_at", late), answered.withWatermark("answered_at", late)
    near = (F.col("answered_at") >= F.col("asked_at")) & (F.col("answered_at") <= F.col("asked_at") + F.expr(f"interval {timeout}"))
    return asked.join(answered, (F.col("asked_key") == F.col("answered_key")) & near, "left").drop("answered_key")


def settled(found: DataFrame, asked: DataFrame, answered: DataFrame, timeout: str, late: str) -> DataFrame:
    """Of exchanges over whole tables those that a stream over the same rows has given out when it has read them all: the
    answered ones, and requests that ran into their timeout before the last watermark."""
    last = lambda df, c: df.agg(F.max(F.date_trunc("millisecond", c)).alias("x"))
    end = last(asked, "asked_at").unionByName(last(answered, "answered_at")).agg(F.min("x").alias("_end"), F.count("x").alias("_sides"))  # one row
    end = end.select(F.when(F.col("_sides") == 2, F.col("_end") - F.expr(f"interval {late}")).alias("_end"), F.lit(1).alias("_one"))
    both = found.withColumn("_one", F.lit(1)).join(F.broadcast(end), "_one")
    passed = F.col("asked_at") + F.expr(f"interval {timeout}") < F.col("_end")
    return both.filter(F.col("response_id").isNotNull() | F.coalesce(passed, F.lit(False))).drop("_one", "_end")


class LateRows:
    """Splits a stream at its watermark: rows that came in time go on, late ones go to a table instead of vanishing.

    The watermark of a micro-batch is the greatest time of earlier ones less ``late``, as Spark's own. Each batch writes to
    folders of its own number, so a batch that is run again after a failure replaces what it wrote. Rows without a time
    count as in time.
    """

    def __init__(self, stream: DataFrame, time: str, late: str, root: str | None = None):
        self.spark, self.schema, self.time, self.late = stream.sparkSession, stream.schema, time, late
        self.root = root or f"{shared_folder(self.spark)}/late-{uuid.uuid4().hex}"
        self.stream = stream

    def _marks(self, number: int):
        seen = [f"{self.root}/marks/{n:09d}" for n in range(number)]
        return self.spark.read.schema("mark timestamp").parquet(*seen).agg(F.max("mark")).first()[0] if seen else None

    def _store(self, batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        mark = self._marks(number)
        behind = F.lit(False) if mark is None else F.coalesce(F.col(self.time) <= F.lit(mark) - F.expr(f"interval {self.late}"), F.lit(False))
        batch.filter(~behind).write.mode("overwrite").parquet(f"{self.root}/in_time/{number:09d}")
        batch.filter(behind).write.mode("overwrite").parquet(f"{self.root}/late/{number:09d}")
        batch.agg(F.max(F.date_trunc("millisecond", self.time)).alias("mark")).write.mode("overwrite").parquet(f"{self.root}/marks/{number:09d}")  # one row
        batch.unpersist()

    def drain(self) -> LateRows:
        """Split what is there now; called again, what has come since."""
        for_each_batch(self.stream, self._store, f"{self.root}/progress").awaitTermination()
        return self

    def in_time(self) -> DataFrame:
        """The rows that came in time, as a stream."""
        return self.spark.readStream.schema(self.schema).option("recursiveFileLookup", "true").parquet(f"{self.root}/in_time")

    def late_rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(f"{self.root}/late")
