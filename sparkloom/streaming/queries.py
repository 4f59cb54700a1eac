"""Queries that run a stream over the given tables, and their SQL. Owner-specified: no reference lists them."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from sparkloom.session import ship
from sparkloom.streaming.distinct import first_rows
from sparkloom.streaming.sessions import sessions, to_table


def _events(spark, sf_dir):
    table = f"{sf_dir}/events.parque"
    # as a pattern, since a stream's plain path has to be a folder
    return spark.readStream.schema(spark.read.parquet(f"{table}t").schema).parquet(f"{table}[t]")


def stream_sessions(spark, sf_dir):
    """Sessions of each user that have ended, read as a stream: six hours without an event, ten minutes of delay."""
    ship(spark)
    found = to_table(sessions(_events(spark, sf_dir), "user_id", "ts", timedelta(hours=6), timedelta(minutes=10)), "sessions")
    return found.select(F.col("key").alias("user_id"), "first_us", "last_us", "n_events", "late")


def stream_first_of_day(spark, sf_dir):
    """Each user's first event of a kind and day, read as a stream with an hour of delay; how many more there were, and how many came too late."""
    ship(spark)
    events = _events(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    found = to_table(first_rows(events, ["user_id", "event_type", "day"], "ts", timedelta(hours=1), timedelta(days=2), ["event_id"]), "first-of-day")
    counts = [F.sum(F.col("kept").cast("long")).alias("n_kept"), F.sum("n_repeated").alias("n_repeated"), F.sum("n_late").alias("n_late")]
    return found.groupBy("key").agg(F.min_by("first.event_id", F.when(F.col("kept"), F.col("at_us"))).alias("first_event"), *counts).select("key.*", "first_event", "n_kept", "n_repeated", "n_late")


QUERIES = {"stream_sessions": stream_sessions, "stream_first_of_day": stream_first_of_day}
SQL = {
    "stream_sessions": """
        WITH e AS (SELECT user_id, epoch_us(ts) AS us FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
        g AS (SELECT *, coalesce(us - lag(us) OVER w >= 21600000000, true) AS begins FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us)),
        n AS (SELECT *, count(*) FILTER (begins) OVER (PARTITION BY user_id ORDER BY us) AS session FROM g),
        s AS (SELECT user_id, min(us) AS first_us, max(us) AS last_us, count(*) AS n_events FROM n GROUP BY user_id, session)
        SELECT user_id, first_us, last_us, n_events, false AS late FROM s
        WHERE last_us + 21600000000 <= ((SELECT max(us) // 1000 FROM e) - 600000) * 1000
    """,
    "stream_first_of_day": """
        SELECT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day, arg_min(event_id, (ts, CAST(event_id AS VARCHAR))) AS first_event,
               CAST(1 AS BIGINT) AS n_kept, count(*) - 1 AS n_repeated, CAST(0 AS BIGINT) AS n_late
        FROM events WHERE ts IS NOT NULL GROUP BY ALL
    """,
}
