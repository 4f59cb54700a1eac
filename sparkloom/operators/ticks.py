"""Points in time as whole numbers, and limits that split their range."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = 86_400_000_000


def ticks(df: DataFrame, name: str) -> Column:
    """A column of whole numbers, dates or timestamps as a long: itself, days, or microseconds.

    A timestamp without time zone is taken as it reads, so its order doesn't
    depend on the session's time zone.
    """
    kind, c = dict(df.dtypes)[name], F.col(f"`{name}`")
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return c.cast("long")
    if kind == "date":
        return F.unix_date(c).cast("long")
    if kind == "timestamp":
        return F.unix_micros(c)
    if kind == "timestamp_ntz":
        day = F.lit(DAY).cast("long")
        seconds = F.extract(F.lit("SECOND"), c)  # with six decimals
        return F.unix_date(c.cast("date")) * day + F.hour(c) * (day / 24).cast("long") + F.minute(c) * (day / 1440).cast("long") + (seconds * 1_000_000).cast("long")
    raise TypeError(f"{name} is of type {kind}: use whole numbers, dates or timestamps")


def span(length: int | timedelta) -> int:
    """A length in ticks: whole numbers as they are, a timedelta in microseconds."""
    return length // timedelta(microseconds=1) if isinstance(length, timedelta) else int(length)


def place(at: Column, limits: list[int]) -> Column:
    """How many of the sorted limits are not above ``at``, by binary search."""
    if not limits:
        return F.lit(0)
    steps, held = [], F.array(*[F.lit(x).cast("long") for x in limits])
    step = 1 << (len(limits).bit_length() - 1)
    while step:
        steps.append(step)
        step >>= 1
    reached = lambda n: F.when(n <= len(limits), F.element_at(held, F.least(n, F.lit(len(limits)))) <= at).otherwise(F.lit(False))
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda n, s: F.when(reached(n + s), n + s).otherwise(n))
