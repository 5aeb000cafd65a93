"""State that an event resets: what happened on a page between one navigation and the next.

Events reach a stream out of order and more than once. A stateful processor holds those of a page until the watermark has
passed them, then takes them in order of time and id, each once; so the result does not depend on how the events were cut
into micro-batches. A segment begins with a resetting event, or with any event after a pause longer than ``idle``; when it
ends, its rows are given out and its state is gone. A page whose last event lies ``idle`` behind the watermark is closed by
a timer and leaves nothing behind.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

#: The state store that timers and typed state need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT = "at long, id long, resets boolean, item string, value double"


class Latest:
    """The last event of each item in a segment."""

    schema = "nav_id long, item string, event_id long, value double"

    @staticmethod
    def add(held: dict, event: tuple) -> None:
        _, number, _, item, value = event
        if item is not None:
            held[item] = [number, value]

    @staticmethod
    def rows(nav: int | None, held: dict) -> list[tuple]:
        return [(nav, item, number, value) for item, (number, value) in held.items()]


class Routes:
    """The distinct items of a segment in order of first occurrence; one list a segment."""

    schema = "nav_id long, routes array<string>"

    @staticmethod
    def add(held: dict, event: tuple) -> None:
        if event[3] is not None:
            held.setdefault(event[3], None)

    @staticmethod
    def rows(nav: int | None, held: dict) -> list[tuple]:
        return [(nav, list(held))] if held else []


class Segments(StatefulProcessor):
    """Events of one page at a time: ``waiting`` until the watermark passes them, then folded into the open segment."""

    def __init__(self, fold: type, key: str, idle_ms: int):
        self.fold, self.key, self.idle = fold, key, idle_ms * 1000
        self.columns = [key, *(f.split()[0] for f in fold.schema.split(", "))]

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", EVENT)
        #: JSON of [last time, navigation, what the fold holds]
        self.open = handle.getValueState("open", "state string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = [event for part in rows for event in events_of(part)]
        self.waiting.appendList(came)
        # the watermark is in milliseconds; no timer is due before the earliest of these is
        self.handle.registerTimer(-(-min(e[0] for e in came) // 1000))
        yield pd.DataFrame(columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(set(self.waiting.get()), key=lambda e: (e[0], e[1]))
        ready = [e for e in waiting if e[0] <= mark]
        last, nav, held = json.loads(self.open.get()[0]) if self.open.exists() else (None, None, {})
        out: list[tuple] = []
        for n, event in enumerate(ready):
            if n and event[:2] == ready[n - 1][:2]:
                continue
            if event[2] or (last is not None and event[0] - last > self.idle):
                out += self.fold.rows(nav, held)
                nav, held = None, {}
            if event[2]:
                nav = event[1]
            else:
                self.fold.add(held, event)
            last = event[0]
        if last is not None and last + self.idle <= mark:
            out += self.fold.rows(nav, held)
            last = None
        rest = [e for e in waiting if e[0] > mark]
        self.waiting.put(rest) if rest else self.waiting.clear()
        self.open.clear() if last is None else self.open.update((json.dumps([last, nav, held]),))
        due = [e[0] for e in rest[:1]] + ([last + self.idle] if last is not None else [])
        if due:
            self.handle.registerTimer(-(-min(due) // 1000))
        yield pd.DataFrame([(key[0], *row) for row in out], columns=self.columns)

    def close(self) -> None:
        pass


def events_of(part: pd.DataFrame) -> list[tuple]:
    times = part["ts"].to_numpy().astype("datetime64[us]").astype("int64").tolist()
    none = lambda v: None if v is None or v != v else v
    return [(t, int(i), bool(r), none(item), none(v)) for t, i, r, item, v in zip(times, part["id"], part["resets"], part["item"], part["value"])]


def prepared(rows: DataFrame, key: str, resets: Column, item: Column, value: Column, id_col: str = "event_id") -> DataFrame:
    """(key, ts, id, resets, item, value): what a segment is made of. Rows without key, time or id are left out."""
    found = rows.select(F.col(key), F.col("ts").cast("timestamp").alias("ts"), F.col(id_col).cast("long").alias("id"), F.coalesce(resets, F.lit(False)).alias("resets"), item.cast("string").alias("item"), value.cast("double").alias("value"))
    return found.filter(F.col(key).isNotNull() & F.col("ts").isNotNull() & F.col("id").isNotNull())


def segments(events: DataFrame, key: str, fold: type, idle_ms: int, late: str | None) -> DataFrame:
    """What ``fold`` gives of every segment, as an append-mode stream over ``prepared`` events. ``late``: the watermark's
    delay, or None if the events have a watermark."""
    kind = events.schema[key].dataType.simpleString()
    grouped = (events.withWatermark("ts", late) if late else events).groupBy(key)
    return grouped.transformWithStateInPandas(Segments(fold, key, idle_ms), f"{key} {kind}, {fold.schema}", "Append", "EventTime")


def numbered(events: DataFrame, key: str, idle_ms: int, late_ms: int | None = None) -> DataFrame:
    """The batch twin's rows: ``events`` once each, with their segment and ``nav_id``. With ``late_ms``, only those that a
    stream with such a delay has given out when it has read all."""
    once = events.groupBy(key, "ts", "id").agg(F.max_by(F.struct("resets", "item", "value"), F.struct("resets", "item", "value")).alias("x")).select(key, "ts", "id", "x.*")
    at = F.unix_micros("ts")
    if late_ms is not None:
        mark = events.agg(((F.floor(F.max(F.unix_micros("ts")) / 1000) - late_ms) * 1000).alias("mark"), F.lit(1).alias("one"))  # one row
        once = once.withColumn("one", F.lit(1)).join(F.broadcast(mark), "one").filter(at <= F.col("mark")).drop("one")
    w = Window.partitionBy(key).orderBy("ts", "id")
    before = F.lag(at).over(w)
    starts = F.col("resets") | before.isNull() | (at - before > idle_ms * 1000)
    seen = once.withColumn("starts", starts).withColumn("segment", F.sum(F.col("starts").cast("int")).over(w))
    seen = seen.withColumn("nav_id", F.max(F.when(F.col("resets"), F.col("id"))).over(Window.partitionBy(key, "segment")))
    if late_ms is not None:
        whole = Window.partitionBy(key)
        seen = seen.withColumn("end", F.max("segment").over(whole)).withColumn("last", F.max(at).over(whole))
        seen = seen.filter((F.col("segment") < F.col("end")) | (F.col("last") + idle_ms * 1000 <= F.col("mark"))).drop("end", "last", "mark")
    return seen.filter(~F.col("resets") & F.col("item").isNotNull())


def latest(seen: DataFrame, key: str) -> DataFrame:
    """The last event of each item of every segment, of ``numbered`` rows."""
    found = seen.groupBy(key, "segment", "nav_id", "item").agg(F.max(F.struct("ts", "id", "value")).alias("x"))
    return found.select(key, "nav_id", "item", F.col("x.id").alias("event_id"), "x.value")


def routes(seen: DataFrame, key: str) -> DataFrame:
    """Distinct items by first occurrence, a list for each segment of ``numbered`` rows."""
    first = seen.groupBy(key, "segment", "nav_id", "item").agg(F.min(F.struct("ts", "id")).alias("x"))
    listed = F.array_sort(F.collect_list(F.struct("x", "item")))  # of one page between two navigations
    return first.groupBy(key, "segment", "nav_id").agg(F.transform(listed, lambda x: x["item"]).alias("routes")).select(key, "nav_id", "routes")
