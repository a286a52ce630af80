"""Streams over the event log; each one's settled output equals the same question in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnway.plans.registry import query
from cairnway.sources.tables import Tables
from cairnway.streaming import jobs


def events(t: Tables):
    return jobs.follow(t.spark, t.folder, "events.parquet")


def local_time(df, column: str):
    """Event time is an instant inside a stream and the table's zone-less time outside."""
    return df.withColumn(column, F.col(column).cast("timestamp_ntz"))


@query("stream_request_rates", """SELECT window_start, user_id, requests, greatest(requests - 2, 0) AS over_limit FROM (
  SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, user_id, count(*) AS requests FROM events GROUP BY 1, 2) WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 60 SECOND FROM events)""")
def _rates(t: Tables):
    """Windows of an hour, two requests allowed; windows the watermark has closed."""
    return local_time(jobs.drain(jobs.request_rates(events(t), "user_id", 2, "1 hour")), "window_start")


@query("stream_weather_rollups", """SELECT until, point_id, count(*) AS readings, CAST(sum(millis) AS BIGINT) AS precipitation_millis FROM (
  SELECT user_id % 20 AS point_id, CAST(floor(value * 1000) AS BIGINT) AS millis, unnest(generate_series(date_trunc('hour', ts) + INTERVAL 1 HOUR, date_trunc('hour', ts) + INTERVAL 24 HOUR, INTERVAL 1 HOUR)) AS until FROM events WHERE event_type = 'click')
  WHERE until <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events WHERE event_type = 'click') GROUP BY 1, 2""")
def _rollups(t: Tables):
    readings = events(t).where(F.col("event_type") == "click").select(
        "ts", (F.col("user_id") % 20).alias("point_id"), F.floor(F.col("value") * 1000).alias("millis")
    )
    return local_time(jobs.drain(jobs.weather_rollups(readings)), "until")


@query("stream_query_sessions", """WITH s AS (SELECT ts, user_id % 50 AS search, ts - lag(ts) OVER (PARTITION BY user_id % 50 ORDER BY ts) >= INTERVAL 5 MINUTE AS fresh FROM events),
  n AS (SELECT *, sum(CASE WHEN coalesce(fresh, true) THEN 1 ELSE 0 END) OVER (PARTITION BY search ORDER BY ts) AS k FROM s)
  SELECT min(ts) AS started, search, count(*) AS searches, count(*) - 1 AS repeats_saved FROM n GROUP BY search, k HAVING max(ts) + INTERVAL 5 MINUTE <= (SELECT max(ts) - INTERVAL 5 MINUTE FROM events)""")
def _sessions(t: Tables):
    searches = events(t).withColumn("search", F.col("user_id") % 50)
    settled = jobs.drain(jobs.query_sessions(searches, "search")).drop("about_users")
    return local_time(settled, "started")


@query("stream_dedupe_features", "SELECT DISTINCT user_id AS feature_id FROM events")
def _first(t: Tables):
    rows = events(t).select("ts", F.col("user_id").alias("feature_id"))
    return jobs.drain(jobs.first_seen(rows, "feature_id")).select("feature_id")


@query("stream_provider_outages", """SELECT window_start, provider, calls, outages, refusals, outages >= 3 AS down FROM (
  SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, provider, count(*) AS calls, count(*) FILTER (outcome = 'outage') AS outages, count(*) FILTER (outcome = 'refused') AS refusals
  FROM v_calls GROUP BY 1, 2) WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 60 SECOND FROM events)""")
def _outages(t: Tables):
    """Outages and refusals per provider in windows of an hour that the watermark has closed."""
    calls = events(t).select(
        "ts", (F.col("user_id") % 5).alias("provider"),
        F.when(F.col("event_type") == "error", "outage").when(F.col("event_type") == "signup", "refused").otherwise("ok").alias("outcome"),
    )
    return local_time(jobs.drain(jobs.outages(calls, "1 hour")), "window_start")
