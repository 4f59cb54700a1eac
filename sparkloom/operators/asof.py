"""As-of join: each left row with the right row of its key that is nearest in time.

Only the distinct (key, time) pairs of the left are matched, with one right row
for each (key, time): both sides are aggregated before they meet. They are put
in order of time within a key, and a running last value gives each left pair its
right row; nothing is paired with anything else. The left rows then join their
pair by key and time.

A key with many rows is split. Keys that hold more than one in ``pieces`` of all
pairs are hot (so fewer than ``pieces`` of them exist, and they are broadcast).
Their rows are dealt into ranges of time, whose limits are approximate quantiles
of the hot rows' times; each range works alone, as it begins with the last right
row of the ranges before it, carried there as a row of its own (one row a hot
key and range at most).

Defined results: every left row comes out once, with nulls for the right where
nothing matches; a null key or time matches nothing; of right rows with equal
key and time the greatest by ``ties`` counts (all right columns by default), so
repeated rows make no difference; of two nearest rows equally far the earlier
one counts; a right column whose name the left has gets ``_right`` added, as
often as needed; empty tables give left rows without matches, or none.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.ticks import place, span, ticks
from sparkloom.session import written

#: Ranges of time for each shuffle partition.
RANGES = 4


def asof_join(
    left: DataFrame,
    right: DataFrame,
    left_time: str,
    right_time: str,
    by: list[tuple[str, str]] | list[str] = (),
    direction: str = "backward",
    tolerance: int | timedelta | None = None,
    exact: bool = True,
    ties: list[str] | None = None,
    pieces: int | None = None,
) -> DataFrame:
    """``left`` with the columns of the matching right row.

    direction: "backward" (the last right row not after the left one), "forward"
    (the first not before it) or "nearest". ``tolerance`` bounds the distance, in
    units of the columns or as a timedelta; without ``exact`` equal times don't
    match. ``by``: columns that have to be equal, as names or (left, right) pairs.
    """
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError(f"direction {direction!r}: use backward, forward or nearest")
    by = [(b, b) if isinstance(b, str) else tuple(b) for b in by]
    pieces = pieces or RANGES * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = _right_names(left, right)
    keys = [f"__key{i}" for i in range(len(by))]

    asked = left.select(*[F.col(f"`{x}`").alias(k) for (x, _), k in zip(by, keys, strict=True)], ticks(left, left_time).alias("__at"))
    asked = asked.dropna().distinct()
    offered = right.select(*[F.col(f"`{y}`").alias(k) for (_, y), k in zip(by, keys, strict=True)], ticks(right, right_time).alias("__at"), F.struct(*[F.col(f"`{c}`") for c in right.columns]).alias("__row"))
    rank = F.struct(*[F.col(f"__row.`{c}`") for c in (ties or [])], F.col("__row")) if ties else F.col("__row")
    offered = offered.dropna(subset=[*keys, "__at"]).groupBy(*keys, "__at").agg(F.max_by("__row", rank).alias("__row"))

    points = written(asked.withColumn("__asks", F.lit(True)).unionByName(offered.withColumn("__asks", F.lit(False)), allowMissingColumns=True), "asof")
    ranged = _in_ranges(points, keys, pieces)
    found = [_running(ranged, keys, d, exact) for d in (("backward", "forward") if direction == "nearest" else (direction,))]
    matches = found[0] if len(found) == 1 else _nearer(*found, keys)
    if tolerance is not None:
        matches = matches.filter(F.abs(F.col("__at") - F.col("__found")) <= span(tolerance))
    matches = matches.select(*keys, "__at", "__row")

    own = left.select("*", *[F.col(f"`{x}`").alias(f"__left{i}") for i, (x, _) in enumerate(by)], ticks(left, left_time).alias("__left_at"))
    same = F.col("__left_at") == F.col("__at")
    for i, k in enumerate(keys):
        same = same & (F.col(f"__left{i}") == F.col(k))
    joined = own.join(matches, same, "left")
    return joined.select(*[F.col(f"`{c}`") for c in left.columns], *[F.col(f"__row.`{c}`").alias(n) for c, n in names.items()])


def _right_names(left: DataFrame, right: DataFrame) -> dict[str, str]:
    taken, names = set(left.columns), {}
    for c in right.columns:
        name = c
        while name in taken or (name != c and name in right.columns):
            name += "_right"
        names[c] = name
        taken.add(name)
    return names


def _in_ranges(points: DataFrame, keys: list[str], pieces: int) -> DataFrame:
    """Points with ``__range``: 0 but for the rows of hot keys."""
    if keys:
        total = points.count()
        # fewer than ``pieces`` rows
        hot = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") * pieces > total)
        marked = points.join(F.broadcast(hot.select(*keys, F.lit(True).alias("__hot"))), keys, "left")
    else:
        marked = points.withColumn("__hot", F.lit(True))
    shares = [i / pieces for i in range(1, pieces)]
    times = marked.filter("__hot").agg(F.percentile_approx("__at", shares, max(10_000, 10 * pieces)).alias("t")).first()["t"] if shares else None
    limits = sorted(set(times or []))
    return marked.withColumn("__range", F.when(F.col("__hot"), place(F.col("__at"), limits)).otherwise(0)).drop("__hot")


def _order(direction: str, exact: bool) -> list[Column]:
    # right rows of an equal time come first where these match
    asks = F.col("__asks") if exact else ~F.col("__asks")
    return [F.col("__at") if direction == "backward" else F.col("__at").desc(), asks]


def _running(points: DataFrame, keys: list[str], direction: str, exact: bool) -> DataFrame:
    """__at, __found (the time of the match) and __row of the pairs that ask and find one."""
    offered = F.when(~F.col("__asks"), F.struct(F.col("__at").alias("found"), F.col("__row").alias("row")))
    # the last right row of each range, carried into the ranges after it: only hot keys have several
    nearest = F.max_by if direction == "backward" else F.min_by
    ranges = points.groupBy(*keys, "__range").agg(nearest(offered, F.when(~F.col("__asks"), F.col("__at"))).alias("__last"))
    later = F.col("__range") if direction == "backward" else F.col("__range").desc()
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(later).rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.withColumn("__carried", F.last("__last", ignorenulls=True).over(before)).filter("__carried is not null")
    carried = carried.select(*keys, "__range", F.col("__carried.found").alias("__at"), F.col("__carried.row").alias("__row"), F.lit(False).alias("__asks"))
    within = Window.partitionBy(*keys, "__range").orderBy(*_order(direction, exact)).rowsBetween(Window.unboundedPreceding, 0)
    seen = points.unionByName(carried).withColumn("__seen", F.last(offered, ignorenulls=True).over(within))
    return seen.filter("__asks and __seen is not null").select(*keys, "__at", F.col("__seen.found").alias("__found"), F.col("__seen.row").alias("__row"))


def _nearer(back: DataFrame, ahead: DataFrame, keys: list[str]) -> DataFrame:
    both = back.unionByName(ahead)
    choice = F.struct(F.abs(F.col("__at") - F.col("__found")), F.col("__found"))
    return both.groupBy(*keys, "__at").agg(F.min_by(F.struct("__found", "__row"), choice).alias("m")).select(*keys, "__at", "m.__found", "m.__row")
