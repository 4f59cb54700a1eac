"""Interval join: pairs of rows whose intervals overlap, each pair once.

Intervals are half open, [start, end). One of length n belongs to the level at
which bins are the least power of four not below n, so it touches two bins
of its level, or of any higher one, at most. A pair meets at the higher of its
two levels: an interval is sent to its own level and to the levels above it that
the other side has (numbers of rows by level are counted first; there are about
as many levels as digits in the longest interval's length). Of the bins that
both touch, the one that holds the later start counts.

So the join is an equality of (keys, level, bin), whose uneven partitions Spark
splits, and its matches stay in proportion to the overlaps: where a long and a
short interval meet, the long one covers a good part of the bin.

Defined results: a null start, end or key matches nothing, and so does an empty
interval (end not after start); lengths have to be under 2 ** 62; with ``closed`` an interval holds its end too, so
that a point has start = end; repeated rows pair each; in a left join rows
without a partner come out once, with nulls; a right column whose name the left
has gets ``_right`` added, as often as needed; empty tables give no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.asof import _right_names
from sparkloom.operators.ticks import ticks
from sparkloom.session import written

#: Bins of a level are 2 ** BITS times as long as those of the one below.
BITS = 2
_SIDE = ("__x", "__y")


def interval_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], by: list[tuple[str, str]] | list[str] = (), how: str = "inner", closed: bool = False) -> DataFrame:
    """Columns of both for every pair whose intervals overlap and whose ``by`` columns are equal. how: "inner" or "left"."""
    if how not in ("inner", "left"):
        raise ValueError(f"how {how!r}: use inner or left")
    by = [(b, b) if isinstance(b, str) else tuple(b) for b in by]
    names = _right_names(left, right)
    if how == "left":
        # written, as such an id is another one each time it is made
        left = written(left.withColumn("__row", F.monotonically_increasing_id()), "interval")
    x = _spans(left, left_span, [a for a, _ in by], closed, 0)
    y = _spans(right, right_span, [b for _, b in by], closed, 1)
    levels = [_levels(s, side) for side, s in zip(_SIDE, (x, y), strict=True)]
    sent_x, sent_y = _sent(x, "__x", levels[1]), _sent(y, "__y", levels[0])

    later = F.greatest("__x_start", "__y_start")
    meet = (F.col("__x_bin") == F.col("__y_bin")) & (F.col("__x_at") == F.col("__y_at"))
    for i in range(len(by)):
        meet = meet & (F.col(f"__x_key{i}") == F.col(f"__y_key{i}"))
    # one of them is of the level at which they meet; the bin is the one that holds the later start
    meet = meet & ((F.col("__x_at") == F.col("__x_level")) | (F.col("__y_at") == F.col("__y_level"))) & (_bin(later, F.col("__x_at")) == F.col("__x_bin"))
    pairs = sent_x.join(sent_y, meet & (later < F.least("__x_end", "__y_end")))
    columns = [*[F.col(f"__x_row.`{c}`").alias(c) for c in left.columns], *[F.col(f"__y_row.`{c}`").alias(n) for c, n in names.items()]]
    found = pairs.select(*columns)
    if how == "inner":
        return found
    alone = left.join(found.select("__row").distinct(), "__row", "left_anti")
    return found.unionByName(alone, allowMissingColumns=True).drop("__row")


def _bin(at: Column, level: Column) -> Column:
    """The bin of a level that holds a point; below zero too."""
    return F.call_function("shiftright", at, (level * BITS).cast("int"))


def _spans(df: DataFrame, span: tuple[str, str], keys: list[str], closed: bool, side: int) -> DataFrame:
    """The rows that can match: keys, start, end, level, and the row itself."""
    p = _SIDE[side]
    start, end = ticks(df, span[0]), ticks(df, span[1]) + (1 if closed else 0)
    rows = df.select(*[F.col(f"`{k}`").alias(f"{p}_key{i}") for i, k in enumerate(keys)], start.alias(f"{p}_start"), end.alias(f"{p}_end"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(f"{p}_row"))
    rows = rows.dropna(subset=[c for c in rows.columns if c != f"{p}_row"]).filter(F.col(f"{p}_end") > F.col(f"{p}_start"))
    length = F.col(f"{p}_end") - F.col(f"{p}_start")
    bits = F.when(length == 1, 0).otherwise(F.length(F.bin(length - 1)))
    return rows.withColumn(f"{p}_level", F.ceil(bits / BITS).cast("int"))


def _levels(spans: DataFrame, side: str) -> list[int]:
    """Levels that have rows: 32 at most."""
    return sorted(r[0] for r in spans.select(f"{side}_level").distinct().collect())


def _sent(spans: DataFrame, side: str, others: list[int]) -> DataFrame:
    """A row for each level and bin at which an interval may meet the other side's."""
    own = F.col(f"{side}_level")
    above = F.filter(F.array(*[F.lit(k) for k in others]) if others else F.array().cast("array<int>"), lambda k: k > own)
    # at its own level it meets what is not longer
    here = F.when(own >= (min(others) if others else 99), F.array(own)).otherwise(F.array().cast("array<int>"))
    placed = spans.withColumn(f"{side}_at", F.explode(F.concat(here, above)))
    at = F.col(f"{side}_at")
    bins = F.sequence(_bin(F.col(f"{side}_start"), at), _bin(F.col(f"{side}_end") - 1, at))
    return placed.withColumn(f"{side}_bin", F.explode(bins))
