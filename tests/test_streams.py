"""Streams in slices, out of order, with late and repeated rows, against their batch twins."""

import json
import os
import random
import shutil
import time
from datetime import datetime, timedelta

import pytest

from tidemill.plans import stream_queries as q
from tidemill.streaming import exchanges, network, segments

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
START = datetime(2024, 1, 1)


def rows(seed, n=400, users=5, minutes=3000):
    r = random.Random(seed)
    kinds = ["view", "click", "purchase", "error", "signup"]
    out = []
    for i in range(n):
        at = START + timedelta(minutes=r.random() * minutes)
        out.append((i, at, r.randrange(users), r.choice(kinds), r.choice([None, r.random()]), json.dumps({"k": r.randrange(6)}) if r.random() < 0.95 else None))
    return sorted(out, key=lambda x: x[1])


def slices(spark, folder, parts):
    """One file a slice; the source reads them in order of their times."""
    for i, part in enumerate(parts):
        file = f"{folder}/{i:03d}.parquet"
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{folder}/_{i}")
        (name,) = [x for x in os.listdir(f"{folder}/_{i}") if x.endswith(".parquet")]
        shutil.move(f"{folder}/_{i}/{name}", file)
        shutil.rmtree(f"{folder}/_{i}")
        os.utime(file, (1_700_000_000 + 10 * i, 1_700_000_000 + 10 * i))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def disorder(seed, found, size=40, by=timedelta(minutes=50)):
    """Slices by time of arrival, up to ``by`` after the event; a tenth of the rows arrives twice."""
    r = random.Random(seed)
    came = sorted([(x[1] + by * r.random(), x) for x in found] + [(x[1] + by * r.random(), x) for x in found if r.random() < 0.1], key=lambda c: c[0])
    return [[x for _, x in came[i : i + size]] for i in range(0, len(came), size)]


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_exchanges_in_slices(spark, tmp_path):
    found = rows(1)
    stream = slices(spark, str(tmp_path), [found[i : i + 60] for i in range(0, len(found), 60)])
    got = network.run_to_end(exchanges.exchanges(*q.sides(stream), "2 hours", "1 hour"), "t", "append")
    table = spark.createDataFrame(found, SCHEMA)
    whole = exchanges.exchanges(*q.sides(table), "2 hours", "1 hour")
    assert same(got, exchanges.settled(whole, *q.sides(table), "2 hours", "1 hour").select(got.columns))
    assert got.filter("response_id is null").count() and got.filter("body is not null").count()
    assert exchanges.settled(whole.limit(0), *q.sides(table.limit(0)), "2 hours", "1 hour").count() == 0


def test_exchanges_forget_what_is_over(spark, tmp_path):
    """The joined state holds the last hours, not the whole stream."""
    found = rows(2, n=600, minutes=20_000)
    stream = slices(spark, str(tmp_path / "in"), [found[i : i + 100] for i in range(0, len(found), 100)])
    joined = exchanges.exchanges(*q.sides(stream), "2 hours", "1 hour")
    running = network.for_each_batch(joined, lambda batch, n: batch.count(), str(tmp_path / "progress"))
    running.awaitTermination()
    kept = [sum(op.numRowsTotal for op in p.stateOperators) for p in running.recentProgress]
    assert max(kept) < 150 and kept[-1] < 30


def test_late_rows_get_a_table(spark, tmp_path):
    at = lambda h: START + timedelta(hours=h)
    parts = [[(1, at(0), 1, "view", None, None), (2, at(10), 1, "click", None, None)], [(3, at(8.9), 1, "click", None, None), (4, at(9.1), 1, "click", None, None), (5, None, 1, "view", None, None)], [(6, at(8), 1, "view", None, None), (7, at(12), 1, "view", None, None)]]
    stream = slices(spark, str(tmp_path / "in"), parts[:2])
    split = exchanges.LateRows(stream, "ts", "1 hour", str(tmp_path / "out")).drain()
    assert [r.event_id for r in split.late_rows().collect()] == [3]
    # resumed: the watermark is that of all batches before, also when a batch is stored again
    slices(spark, str(tmp_path / "in2"), parts)
    os.rename(tmp_path / "in2/002.parquet", tmp_path / "in/002.parquet")
    split = exchanges.LateRows(stream, "ts", "1 hour", str(tmp_path / "out")).drain()
    split._store(spark.createDataFrame(parts[2], SCHEMA), 2)
    assert sorted(r.event_id for r in split.late_rows().collect()) == [3, 6]
    again = network.run_to_end(split.in_time(), "t", "append")
    assert sorted(r.event_id for r in again.collect()) == [1, 2, 4, 5, 7]


@pytest.mark.parametrize("fold,twin", [(segments.Latest, segments.latest), (segments.Routes, segments.routes)])
def test_segments_out_of_order_and_repeated(spark, tmp_path, fold, twin):
    found = rows(3)
    stream = slices(spark, str(tmp_path), disorder(4, found))
    idle = 4 * 3_600_000
    got = network.run_to_end(segments.segments(q.visits(stream), "user_id", fold, idle, "1 hour"), "t", "append", segments.PROVIDER)
    seen = segments.numbered(q.visits(spark.createDataFrame(found, SCHEMA)), "user_id", idle, 3_600_000)
    assert same(got, twin(seen, "user_id").select(got.columns)) and got.count() > 20
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != segments.PROVIDER


def test_state_of_an_idle_page_is_dropped(spark, tmp_path):
    """Pages that fell silent leave no state: only the one that goes on has any."""
    quiet = [(u, START + timedelta(minutes=u), u, "click", 1.0, '{"k": 1}') for u in range(20)]
    goes_on = [(100 + h, START + timedelta(hours=h), 99, "click", 1.0, '{"k": 2}') for h in range(60)]
    parts = [quiet, goes_on[:20], goes_on[20:40], goes_on[40:]]
    stream = slices(spark, str(tmp_path / "in"), parts)
    out = segments.segments(q.visits(stream), "user_id", segments.Latest, 6 * 3_600_000, "1 hour")
    with network.state_store(spark, segments.PROVIDER):
        running = network.for_each_batch(out, lambda batch, n: batch.write.parquet(str(tmp_path / f"out/batch={n}")), str(tmp_path / "progress"))
    running.awaitTermination()
    kept = [p.stateOperators[0].numRowsTotal for p in running.recentProgress if p.stateOperators]
    assert max(kept) >= 20 and kept[-1] < 10
    closed = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.user_id for r in closed.select("user_id").distinct().collect()) == list(range(20))


def test_sessions_in_slices(spark, tmp_path):
    found = rows(5, n=300, minutes=20_000)
    stream = slices(spark, str(tmp_path), disorder(6, found))
    got = network.run_to_end(network.quiet_sessions(stream, "12 hours", "1 hour"), "t", "append")
    spans = {}
    for _, at, user, *_ in found:
        spans.setdefault(user, []).append(at)
    mark = max(x[1] for x in found) - timedelta(hours=1)
    want = []
    for user, times in spans.items():
        begin = last = times[0]
        for t in [*times[1:], None]:
            if t is None or t - last >= timedelta(hours=12):
                if last + timedelta(hours=12) <= mark:
                    want.append((user, begin, last + timedelta(hours=12)))
                begin = t
            last = t
    assert sorted((r.user_id, r.begin, r.end) for r in got.collect()) == sorted(want) and len(want) > 10


def test_rows_without_key_time_or_item(spark, tmp_path):
    found = [(1, START, None, "click", 1.0, '{"k": 1}'), (2, None, 1, "click", 1.0, '{"k": 1}'), (3, START, 1, None, None, None), (4, START, 1, "click", None, '{"k": 1}'), (5, START + timedelta(days=3), 2, "view", 1.0, None)]
    stream = slices(spark, str(tmp_path), [found])
    got = network.run_to_end(segments.segments(q.visits(stream), "user_id", segments.Latest, 3_600_000, "1 hour"), "t", "append", segments.PROVIDER)
    assert [tuple(r) for r in got.collect()] == [(1, None, "1", 4, None)]
    twin = segments.latest(segments.numbered(q.visits(spark.createDataFrame(found, SCHEMA)), "user_id", 3_600_000, 3_600_000), "user_id")
    assert same(got, twin.select(got.columns))


def test_progress_of_streams(spark, tmp_path):
    found = rows(7, n=200)
    late = [(900, START - timedelta(days=30), 1, "click", 1.0, None)]
    stream = slices(spark, str(tmp_path), [found[:100], found[100:], late])
    with network.Progress(spark) as seen:
        network.run_to_end(network.quiet_sessions(stream, "12 hours", "1 hour"), "t", "append")
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        for _ in range(100):
            if seen.seen and all(v["ended"] for v in seen.seen.values()):
                break
            time.sleep(0.1)
    (row,) = seen.table().collect()
    assert (row.rows, row.late, row.ended) == (201, 1, "done") and row.batches >= 3


def test_exchanges_of_what_came_in_time(spark, tmp_path):
    """Slices out of order by up to three hours: late rows go to their table, the rest is joined as a batch would."""
    r = random.Random(8)
    found = rows(9, n=500)
    came = [x for _, x in sorted(((x[1] + timedelta(hours=3 * r.random()), x) for x in found), key=lambda c: c[0])]
    stream = slices(spark, str(tmp_path / "in"), [came[i : i + 50] for i in range(0, len(came), 50)])
    split = exchanges.LateRows(stream, "ts", "1 hour", str(tmp_path / "out")).drain()
    late = {x.event_id for x in split.late_rows().collect()}
    kept = [x for x in found if x[0] not in late]
    assert 0 < len(late) < len(found) / 2 and split.in_time().isStreaming
    got = network.run_to_end(exchanges.exchanges(*q.sides(split.in_time()), "2 hours", "1 hour"), "t", "append")
    table = spark.createDataFrame(kept, SCHEMA)
    whole = exchanges.exchanges(*q.sides(table), "2 hours", "1 hour")
    assert same(got, exchanges.settled(whole, *q.sides(table), "2 hours", "1 hour").select(got.columns))
