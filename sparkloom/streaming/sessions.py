"""Sessions of a stream by keyed state and timers, with late events counted apart.

A session is a run of a key's events, each less than ``gap`` after the one before
it. Events may come in any order and in any batch: sessions grow, and two that
an event connects become one, as long as the watermark (the latest time seen
less ``delay``) hasn't reached a session's end plus ``gap``. Then a timer emits
the session and its state goes. Events that connect with no open session, and
with the others of their batch make one that would have ended when the batch
began, are late: they are emitted at once, marked as late. So of all events each is in one emitted session, in one
late row, or in a session still open.

Before the shuffle each task joins a batch's events to partial sessions, so of a
key with very many events a task sends a few rows; the state of a key holds a
start, an end and a number for each open session, no events. Keys share calls and
state in buckets (see ``buckets``), as text.

Spark keeps offsets, state and timers in the checkpoint, so a query that stops
goes on where it was, with the same sessions.

Defined results: events without a time or with a null key are left out; events
at equal times belong together; repeated events count each; an empty stream
emits nothing; other columns are not read. Times are compared with the
watermark, which Spark keeps in milliseconds.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.ticks import span
from sparkloom.session import shared_dir
from sparkloom.streaming.buckets import BUCKETS, JSON, Bucket, bucket_of

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
ROW = "first_us long, last_us long, n_events long"


def joined(spans: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """(first, last, number) of the sessions that (first, last, number) pieces make together."""
    out: list[tuple[int, int, int]] = []
    for first, last, n in sorted(spans):
        if out and first - out[-1][1] < gap:
            out[-1] = out[-1][0], max(out[-1][1], last), out[-1][2] + n
        else:
            out.append((first, last, n))
    return out


def partial_sessions(pdf: pd.DataFrame, gap: int) -> pd.DataFrame:
    """Pieces of sessions (key, first_us, last_us, n_events) of events (key, at)."""
    pdf = pdf.sort_values(["key", "at"], kind="stable")
    key, at = pdf["key"], pdf["at"].to_numpy(np.int64)
    begins = np.ones(len(pdf), bool)
    begins[1:] = (key.to_numpy()[1:] != key.to_numpy()[:-1]) | (np.diff(at) >= gap)
    first = np.flatnonzero(begins)
    last = np.append(first[1:], len(pdf)) - 1
    return pd.DataFrame({"key": key.iloc[first].to_numpy(), "first_us": at[first], "last_us": at[last], "n_events": last - first + 1})


class Sessions(Bucket):
    """Open sessions of a bucket's keys, and what becomes of pieces that come in."""

    COLUMNS = {"key": "string", "first_us": "long", "last_us": "long", "n_events": "long"}

    def __init__(self, gap: int):
        self.gap = gap

    def due(self, last: int) -> int:
        """The watermark, in milliseconds, at which a session is closed."""
        return -(-(last + self.gap) // 1000)

    def keep(self, rows: list[tuple], was: int | None, now: int) -> Iterator[pd.DataFrame]:
        """Emit what is closed of (key, first, last, number); keep the others, and set the timer at which the next one is."""
        closed, open_ = [], []
        for row in rows:
            (closed if self.due(row[2]) <= now else open_).append(row)
        self.write(open_, min((self.due(row[2]) for row in open_), default=None), was)
        if closed:
            yield out(closed, False)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        stored, was = self.read()
        before: dict[str, list[tuple[int, int, int]]] = {}
        pieces: dict[str, list[tuple[int, int, int]]] = {}
        for k, *s in stored:
            before.setdefault(k, []).append(tuple(s))
        for pdf in rows:
            for k, *s in zip(*(pdf[c].tolist() for c in ("key", "first_us", "last_us", "n_events")), strict=True):
                pieces.setdefault(k, []).append(tuple(s))
        stay, late = [row for row in stored if row[0] not in pieces], []
        for k, new in pieces.items():
            open_ = before.get(k, [])
            for s in joined([*open_, *new], self.gap):
                met = self.due(s[1]) > now or any(s[0] <= first <= s[1] for first, _, _ in open_)
                (stay if met else late).append((k, *s))
        if late:
            yield out(late, True)
        yield from self.keep(stay, was, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        stored, was = self.read()
        yield from self.keep(stored, was, timerValues.getCurrentWatermarkInMs())


def out(rows: list[tuple], late: bool) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["key", "first_us", "last_us", "n_events"]).assign(late=late)


def sessions(events: DataFrame, key: str, time: str, gap: timedelta, delay: timedelta, buckets: int = BUCKETS) -> DataFrame:
    """key, first_us, last_us (microseconds since 1970), n_events, late: closed sessions of a stream, and late events in pieces of sessions.

    ``time`` has to be a timestamp with or without time zone; the latter is taken in
    the session's time zone. Start the result with ``to_table``, or set STORE first.
    """
    length = span(gap)
    rows = events.select(F.col(f"`{key}`").alias("key"), F.col(f"`{time}`").cast("timestamp").alias("time")).dropna()
    shape = rows.sparkSession.createDataFrame([], rows.schema).select(F.struct("key").alias("key")).schema
    kind = dict(rows.dtypes)["key"]
    plain = (F.col("key") + F.lit(0)).cast(kind) if kind in ("float", "double") else F.col("key")  # -0.0 is 0.0
    text = F.to_json(F.struct(plain.alias("key")), JSON).alias("key")
    timed = rows.withWatermark("time", f"{span(delay) // 1000} milliseconds").select(text, F.unix_micros("time").alias("at"))

    def pieces(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            yield partial_sessions(pdf, length)

    dealt = timed.mapInPandas(pieces, f"key string, {ROW}").select(bucket_of("key", buckets), "*")
    found = dealt.groupBy("bucket").transformWithStateInPandas(Sessions(length), f"key string, {ROW}, late boolean", "Append", "EventTime")
    return found.select(F.from_json("key", shape["key"].dataType, JSON)["key"].alias("key"), "first_us", "last_us", "n_events", "late")


def batch_sessions(events: DataFrame, key: str, time: str, gap: timedelta) -> DataFrame:
    """key, first_us, last_us, n_events of all sessions of a table, by Spark's own window."""
    rows = events.select(F.col(f"`{key}`").alias("key"), F.col(f"`{time}`").cast("timestamp").alias("time")).dropna()
    window = F.session_window("time", f"{span(gap)} microseconds")
    found = rows.groupBy("key", window).agg(F.min("time").alias("first"), F.max("time").alias("last"), F.count(F.lit(1)).alias("n_events"))
    return found.select("key", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"), "n_events")


def to_table(stream: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """All that is there of a stream, run into a Parquet table in the shared folder; the table, read back.

    Give ``path`` to go on from an earlier run: the checkpoint lies beside the table.
    """
    spark = stream.sparkSession
    path = path or f"{shared_dir(spark)}/sparkloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    was = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        stream.writeStream.format("parquet").option("path", f"{path}/table").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        if was is None:
            spark.conf.unset(STORE[0])
        else:
            spark.conf.set(STORE[0], was)
    return spark.read.schema(stream.schema).parquet(f"{path}/table")
