"""Row numbers and running totals over a whole table, without one task that sees it.

Rows are dealt into ranges of the order and sorted there, once; their places
within a range are written beside them. The sizes (or totals) of the ranges,
one row each, are added up, and every row adds what stands before its range.

Rows that the order leaves equal are told apart by a hash of all their columns,
so that a value that many rows share is split as well; rows equal in every
column are alike. Null keys come first in ascending and last in descending
order, as in Spark. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.session import written

_PLACE = 33  # bits of a monotonically increasing id that count within a partition


def _ranged(df: DataFrame, order: list[Column], ranges: int | None) -> DataFrame:
    """Rows with __range and __place (from 0 within it), written in order."""
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ties = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    told = df.withColumn("__tie", ties)
    ordered = told.repartitionByRange(ranges, *order, F.col("__tie")).sortWithinPartitions(*order, F.col("__tie"), *[F.col(f"`{c}`") for c in df.columns])
    at = F.monotonically_increasing_id()
    return written(ordered.withColumn("__at", at).select(*[F.col(f"`{c}`") for c in df.columns], F.shiftright("__at", _PLACE).alias("__range"), (F.col("__at") % (1 << _PLACE)).alias("__place")), "ordered")


def _before(ranged: DataFrame, total: Column) -> DataFrame:
    """(__range, __before): what stands before each range. One row a range comes to the driver."""
    sums = ranged.groupBy("__range").agg(total.alias("__before"))
    rows, so_far = [], None
    for place, own in sorted(sums.collect()):
        so_far = own - own if so_far is None else so_far
        rows.append((place, so_far))
        so_far += own
    kind = dict(sums.dtypes)["__before"]
    return F.broadcast(ranged.sparkSession.createDataFrame(rows, f"__range long, __before {kind}"))


def with_row_numbers(df: DataFrame, *order: Column, name: str = "row_number", ranges: int | None = None) -> DataFrame:
    """``df`` with each row's number in the order, from 1."""
    ranged = _ranged(df, list(order), ranges)
    return ranged.join(_before(ranged, F.count(F.lit(1))), "__range").select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__before") + F.col("__place") + 1).alias(name))


def with_running_total(df: DataFrame, value: Column, *order: Column, name: str = "running_total", ranges: int | None = None) -> DataFrame:
    """``df`` with the total of ``value`` over all rows up to its own; nulls count nothing.

    ``value`` should be of an exact type (whole numbers, decimals), as sums of doubles depend on their order.
    """
    valued = df.withColumn("__value", value)
    ranged = _ranged(valued, list(order), ranges)
    so_far = Window.partitionBy("__range").orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
    sums = ranged.withColumn("__sum", F.coalesce(F.sum("__value").over(so_far), F.lit(0)))
    return sums.join(_before(ranged, F.coalesce(F.sum("__value"), F.lit(0))), "__range").select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__before") + F.col("__sum")).alias(name))
