"""The first row of each key of a stream, with repeated and late rows counted apart.

A row's key is kept the first time it is met; later rows of the key are repeated
ones as long as the key's state lives, which is until the watermark (the latest
time seen less ``delay``) has passed the key's last row by ``horizon``. So state is bounded by the
keys of a horizon, and two rows kept of one key are more than a horizon less a
grain apart. Times are judged in grains, a sixteenth of the delay: a row is late
when its grain ended before the batch's watermark. Late rows are never kept and
change no state. Each row is thus exactly one of kept, repeated and late, and
``rows in = kept + repeated + late`` holds for the rows of every stretch of
batches, across restarts from the checkpoint.

Before the shuffle each task joins the rows of a key and grain to a count and
the earliest row, so of a key with very many rows a task sends a few. Keys share
calls and state in buckets (see ``buckets``).

Defined results: nulls in a key equal each other; rows without a time are left
out, as they can't be judged; of rows of one key in a batch the earliest is
kept, of equal times the one whose JSON text is least; repeated rows count each;
an empty stream gives nothing; columns that aren't named are not read, and keys
and kept columns come back in structs, so no name clashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.ticks import span
from sparkloom.streaming.buckets import BUCKETS, JSON, Bucket, bucket_of

GRAINS = 16
PIECE = "key string, at long, last long, first string, n long"
OUT = "key string, kept boolean, at_us long, first string, n_repeated long, n_late long"


def pieces(pdf: pd.DataFrame, grain: int) -> pd.DataFrame:
    """One row for each key and grain of rows (key, at, first): the earliest, the last time, and how many there are."""
    pdf = pdf.assign(grain=pdf["at"] // grain).sort_values(["key", "grain", "at", "first"], kind="stable")
    got = pdf.groupby(["key", "grain"], sort=False).agg(at=("at", "first"), last=("at", "last"), first=("first", "first"), n=("at", "size"))
    return got.reset_index()[["key", "at", "last", "first", "n"]]


class FirstOfKey(Bucket):
    """The time of each key's last row, while it may still be repeated."""

    COLUMNS = {"key": "string", "last": "long"}

    def __init__(self, grain: int, horizon: int):
        self.grain, self.horizon = grain, horizon

    def due(self, last: int) -> int:
        """The watermark, in milliseconds, at which a key is forgotten."""
        return -(-(last + self.horizon) // 1000)

    def keep(self, known: dict[str, int], was: int | None, now: int) -> None:
        """Keep the keys that aren't forgotten, and set the timer at which the next one is."""
        rows = [(key, last) for key, last in known.items() if self.due(last) > now]
        self.write(rows, min((self.due(last) for _, last in rows), default=None), was)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        least, n, n_late, best, latest = {}, {}, {}, {}, {}
        for pdf in rows:
            for k, at, end, first, count in zip(*(pdf[c].tolist() for c in ("key", "at", "last", "first", "n")), strict=True):
                least[k] = min(at, least.get(k, at))
                if (at // self.grain + 1) * self.grain <= now * 1000:
                    n_late[k] = n_late.get(k, 0) + count
                    continue
                n[k] = n.get(k, 0) + count
                best[k] = min((at, first), best.get(k, (at, first)))
                latest[k] = max(end, latest.get(k, end))
        before, was = self.read()
        known = dict(before)
        # the timer of a key that is known may be still to come in this batch
        kept = [k in n and (k not in known or self.due(known[k]) <= now) for k in least]
        for k, last in latest.items():
            known[k] = max(last, known.get(k, last))
        self.keep(known, was, now)
        yield pd.DataFrame(
            {
                "key": list(least),
                "kept": kept,
                "at_us": [best[k][0] if k in best else at for k, at in least.items()],
                "first": [best[k][1] if new else None for k, new in zip(least, kept, strict=True)],
                "n_repeated": [n.get(k, 0) - new for k, new in zip(least, kept, strict=True)],
                "n_late": [n_late.get(k, 0) for k in least],
            }
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        before, was = self.read()
        self.keep(dict(before), was, timerValues.getCurrentWatermarkInMs())
        yield from ()


def first_rows(events: DataFrame, keys: list[str], time: str, delay: timedelta, horizon: timedelta, keep: list[str], buckets: int = BUCKETS) -> DataFrame:
    """key struct, kept, at_us, first struct (``keep`` of the kept row, else null), n_repeated, n_late: one row for each key that a batch holds.

    ``at_us`` is the earliest time of the key's rows in that batch that aren't late (of all, if
    all are). Start the result with ``sessions.to_table``, or set its STORE first.
    """
    if span(horizon) < span(delay) or span(delay) < GRAINS * 1000:
        raise ValueError("the delay has to be 16 ms or more, and the horizon not shorter than the delay")
    grain, shape = span(delay) // GRAINS, events.sparkSession.createDataFrame([], events.schema)
    struct = lambda names: F.struct(*[F.col(f"`{c}`") for c in names])
    kinds = shape.select(struct(keys).alias("key"), struct(keep).alias("first")).schema
    text = lambda names: F.to_json(struct(names), JSON)
    rows = events.select(text(keys).alias("key"), text(keep).alias("first"), F.col(f"`{time}`").cast("timestamp").alias("time")).filter(F.col("time").isNotNull())
    timed = rows.withWatermark("time", f"{span(delay) // 1000} milliseconds").select("key", F.unix_micros("time").alias("at"), "first")

    def cut(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            yield pieces(pdf, grain)

    dealt = timed.mapInPandas(cut, PIECE).select(bucket_of("key", buckets), "*")
    found = dealt.groupBy("bucket").transformWithStateInPandas(FirstOfKey(grain, span(horizon)), OUT, "Append", "EventTime")
    back = lambda name: F.from_json(name, kinds[name].dataType, JSON).alias(name)
    return found.select(back("key"), "kept", "at_us", back("first"), "n_repeated", "n_late")
