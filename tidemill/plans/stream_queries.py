"""Registered queries that run as streams over ``events`` to the end of what is there, each with the SQL of its result.

``events`` stands for what a browser reports: a view is a request and a navigation, clicks, purchases and errors are
responses, the number in ``props`` is the URL.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import exchanges, network, segments
from .lineage import shared_folder
from .queries import C, query, table

TIMEOUT, LATE, IDLE_HOURS, QUIET = "2 hours", "1 hour", 24, "12 hours"
LATE_MS, IDLE_MS = 3_600_000, IDLE_HOURS * 3_600_000
#: The watermark of a stream that has read all events, in microseconds.
_MARK = f"(SELECT (epoch_us(max(ts)) // 1000 - {LATE_MS}) * 1000 FROM events)"


def sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests and responses among ``rows``."""
    kind = F.when(C("event_type") == "click", "js").when(C("event_type") == "purchase", "document").otherwise("api")
    status = F.when(C("event_type") == "error", 500).otherwise(200)
    asked = exchanges.requests(rows, C("event_type") == "view", "user_id")
    return asked, exchanges.responses(rows, C("event_type").isin("click", "purchase", "error"), "user_id", kind, status, C("props"))


def timed(found: DataFrame) -> DataFrame:
    wait = F.unix_micros("answered_at") - F.unix_micros("asked_at")
    return found.select("request_id", C("asked_key").alias("user_id"), "response_id", wait.alias("wait_us"), "kind", "status", "body")


def visits(rows: DataFrame) -> DataFrame:
    """Events of a page as segments see them: views reset, the rest name a URL."""
    return segments.prepared(rows, "user_id", C("event_type") == "view", F.get_json_object("props", "$.k"), C("value"))


@query(f"""WITH q AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'),
a AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'click' THEN 'js' WHEN 'purchase' THEN 'document' ELSE 'api' END AS kind, CASE event_type WHEN 'error' THEN 500 ELSE 200 END AS status,
  CASE WHEN event_type = 'click' THEN props END AS body FROM events WHERE event_type IN ('click', 'purchase', 'error')),
m AS (SELECT least((SELECT date_trunc('millisecond', max(ts)) FROM q), (SELECT date_trunc('millisecond', max(ts)) FROM a)) - INTERVAL {LATE} AS mark)
SELECT q.event_id AS request_id, q.user_id, a.event_id AS response_id, epoch_us(a.ts) - epoch_us(q.ts) AS wait_us, kind, status, body
FROM q LEFT JOIN a ON q.user_id = a.user_id AND a.ts >= q.ts AND a.ts <= q.ts + INTERVAL {TIMEOUT} WHERE a.event_id IS NOT NULL OR q.ts + INTERVAL {TIMEOUT} < (SELECT mark FROM m)""")
def exchanges_stream(spark, sf_dir):
    """Requests with their responses, from two streams that meet."""
    return timed(network.run_to_end(exchanges.exchanges(*sides(network.events(spark, sf_dir)), TIMEOUT, LATE), "exchanges", "append"))


@query(f"""WITH q AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'), a AS (SELECT * FROM events WHERE event_type IN ('click', 'purchase', 'error'))
SELECT q.event_id AS request_id, q.user_id, a.event_id AS response_id, epoch_us(a.ts) - epoch_us(q.ts) AS wait_us, CASE event_type WHEN 'click' THEN 'js' WHEN 'purchase' THEN 'document' WHEN 'error' THEN 'api' END AS kind,
  CASE event_type WHEN 'error' THEN 500 WHEN 'click' THEN 200 WHEN 'purchase' THEN 200 END AS status, CASE WHEN event_type = 'click' THEN props END AS body
FROM q LEFT JOIN a ON q.user_id = a.user_id AND a.ts >= q.ts AND a.ts <= q.ts + INTERVAL {TIMEOUT}""")
def exchanges_batch(spark, sf_dir):
    """The same plan over the table."""
    return timed(exchanges.exchanges(*sides(table(spark, sf_dir, "events").withColumn("ts", C("ts").cast("timestamp"))), TIMEOUT, LATE))


_SEGMENTS = f"""WITH e AS (SELECT user_id, epoch_us(ts) AS us, event_id, event_type = 'view' AS resets, json_extract_string(props, '$.k') AS item, value FROM events
  WHERE user_id IS NOT NULL AND ts IS NOT NULL AND epoch_us(ts) <= {_MARK}),
s AS (SELECT *, resets OR lag(us) OVER w IS NULL OR us - lag(us) OVER w > {IDLE_MS * 1000} AS starts FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
n AS (SELECT *, sum(starts::INT) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS segment FROM s),
k AS (SELECT *, max(CASE WHEN resets THEN event_id END) OVER (PARTITION BY user_id, segment) AS nav_id, max(segment) OVER (PARTITION BY user_id) AS final, max(us) OVER (PARTITION BY user_id) AS latest FROM n),
seen AS (SELECT * FROM k WHERE (segment < final OR latest + {IDLE_MS * 1000} <= {_MARK}) AND NOT resets AND item IS NOT NULL)"""


@query(_SEGMENTS + " SELECT user_id, nav_id, item, arg_max(event_id, (us, event_id)) AS event_id, arg_max(value, (us, event_id)) AS value FROM seen GROUP BY user_id, segment, nav_id, item")
def navigation_latest_stream(spark, sf_dir):
    """The last response of each URL within its navigation; a navigation resets the page's state."""
    events = visits(network.events(spark, sf_dir))
    return network.run_to_end(segments.segments(events, "user_id", segments.Latest, IDLE_MS, LATE), "navigation-latest", "append", segments.PROVIDER)


@query(_SEGMENTS + """, f AS (SELECT user_id, segment, nav_id, item, min((us, event_id)) AS first FROM seen GROUP BY ALL)
SELECT user_id, nav_id, list(item ORDER BY first) AS routes FROM f GROUP BY user_id, segment, nav_id""")
def spa_routes_stream(spark, sf_dir):
    """Distinct routes of a page between two navigations, in order of first occurrence; events delivered twice count once."""
    rows = network.events(spark, sf_dir).withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["event_id"])
    return network.run_to_end(segments.segments(visits(rows), "user_id", segments.Routes, IDLE_MS, None), "spa-routes", "append", segments.PROVIDER)


@query(f"""WITH s AS (SELECT user_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < {QUIET.split()[0]} * 3600000000 THEN 0 ELSE 1 END AS starts FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS session FROM s),
g AS (SELECT user_id, min(us) AS began, max(us) + {QUIET.split()[0]} * 3600000000 AS quiet, count(*) AS n FROM n GROUP BY user_id, session)
SELECT user_id, began AS began_us, quiet AS quiet_us, n FROM g WHERE quiet <= {_MARK}""")
def quiet_sessions_stream(spark, sf_dir):
    """Pages that have been quiet: sessions given out once the watermark has passed their end."""
    found = network.run_to_end(network.quiet_sessions(network.events(spark, sf_dir), QUIET, LATE), "quiet", "append")
    return found.select("user_id", F.unix_micros("begin").alias("began_us"), F.unix_micros("end").alias("quiet_us"), "n")


# Events come in up to four days after they happened, in slices of four days.
_LAG_HOURS, _SLICE, _PATIENCE = 97, 4 * 86_400, "1 day"


@query(f"""WITH s AS (SELECT event_id, ts, floor((epoch_us(ts) // 1000000 + event_id % {_LAG_HOURS} * 3600) / {_SLICE}) AS slot FROM events),
m AS (SELECT slot, (SELECT max(date_trunc('millisecond', ts)) FROM s e WHERE e.slot < a.slot) - INTERVAL {_PATIENCE} AS mark FROM (SELECT DISTINCT slot FROM s) a)
SELECT event_id, coalesce(ts <= mark, false) AS late FROM s JOIN m USING (slot)""")
def late_rows_stream(spark, sf_dir):
    """Events as they come in, slice after slice: which of them are behind the watermark of what had come before."""
    slot = F.floor((F.floor(F.unix_micros("ts") / 1_000_000) + C("event_id") % _LAG_HOURS * 3600) / _SLICE)
    rows = table(spark, sf_dir, "events").withColumn("ts", C("ts").cast("timestamp")).withColumn("slot", slot)
    root = f"{shared_folder(spark)}/arrivals-{uuid.uuid4().hex}"
    split = None
    for (number,) in sorted(rows.select("slot").distinct().collect()):  # a few
        rows.filter(C("slot") == number).drop("slot").write.mode("append").parquet(f"{root}/in")
        split = split or exchanges.LateRows(spark.readStream.schema(rows.drop("slot").schema).parquet(f"{root}/in"), "ts", _PATIENCE, f"{root}/split")
        split.drain()
    if split is None:
        return rows.select("event_id", F.lit(False).alias("late"))
    in_time = spark.read.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{root}/split/in_time")
    return in_time.select("event_id", F.lit(False).alias("late")).unionByName(split.late_rows().select("event_id", F.lit(True).alias("late")))
