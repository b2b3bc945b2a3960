"""Streaming queries, each run over all that is there and held against a batch query."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricewright.plans.registry import query
from pricewright.sources.domain import Domain
from pricewright.streaming import feeds


def start_of(c: str = "window"):
    return F.date_format(F.col(f"{c}.start"), "yyyy-MM-dd HH:mm")


@query("stm01_latest_state", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def stm01(d: Domain):
    return feeds.batch_of(lambda s: feeds.latest_state(s, "user_id", ["event_id"]), d.spark, d.folder).select("user_id", "last.event_id")


@query("stm02_daily_trips", "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, sum(CAST(floor(value * 100 + 0.5) AS BIGINT))::BIGINT AS cents FROM events WHERE event_type = 'purchase' GROUP BY ALL")
def stm02(d: Domain):
    return feeds.batch_of(feeds.daily_trips, d.spark, d.folder).select("user_id", F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n", "cents")


@query("stm03_rate_limit", """
w AS (SELECT user_id, unnest([time_bucket(INTERVAL 5 MINUTE, ts), time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL 5 MINUTE]) AS start FROM events)
SELECT user_id, strftime(start, '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM w GROUP BY ALL HAVING count(*) > 1""")
def stm03(d: Domain):
    return feeds.batch_of(lambda s: feeds.vote_rate(s, 1), d.spark, d.folder).select("user_id", start_of().alias("start"), "n")


@query("stm06_deduplicated", "SELECT count(*) AS n FROM (SELECT DISTINCT user_id, event_type, props FROM events)")
def stm06(d: Domain):
    return feeds.batch_of(lambda s: feeds.first_seen(s, ["user_id", "event_type", "props"]), d.spark, d.folder, "append").agg(F.count("*").alias("n"))


@query("stm07_daily_counters", "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL")
def stm07(d: Domain):
    return feeds.batch_of(feeds.daily_counters, d.spark, d.folder).select("event_type", F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n")


@query("stm08_sessions", """
g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 3 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM s GROUP BY user_id, session""")
def stm08(d: Domain):
    return feeds.batch_of(lambda s: feeds.sessions(s, "3 hours"), d.spark, d.folder).select("user_id", start_of("session_window").alias("start"), "n")
