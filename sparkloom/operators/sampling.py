"""Weighted samples of an exact size in each stratum.

Every row draws u, a number between 0 and 1 that a hash of its id and the seed
gives, and waits -ln(u) / weight; the ``size`` rows of a stratum that wait least
are its sample. That is drawing without replacement, each draw with a chance in
proportion to the weights of the rows still there. The same seed gives the same
sample, however the rows are dealt, and a larger size gives a superset.

Each task keeps the ``size`` first rows of each stratum before anything is
shuffled, so a stratum of any length costs a task no more than that; the tasks
fall into LANES of partial samples, which are cut to ``size`` again, and at
last the lanes of a stratum meet: LANES times ``size`` rows at most. No stratum
is sorted or gathered whole. Spark keeps first rows in tasks only up to
``spark.sql.optimizer.windowGroupLimitThreshold``; a larger size raises that setting
of the session.

With ``chances`` each row also carries the chance at which it got into the sample,
1 - exp(-weight * t), t being the wait of the first row left out (1.0 in strata
that are sampled whole). Summing value / chance over the sample estimates the
sum over the stratum without bias.

Defined results: rows whose weight is null, not finite, zero or negative are
never drawn; a stratum with fewer rows gives them all, and one without any
gives nothing; a null stratum is one of its own; rows with the same id wait
equally if their weights are equal, and are ordered by a hash of the whole row;
rows repeated in every column may be drawn each; empty tables give empty ones;
columns of any name come through, those named like the added ones are refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANES = 64
THRESHOLD = "spark.sql.optimizer.windowGroupLimitThreshold"
BITS = 52


def uniform(ids: list[Column], seed: int) -> Column:
    """A number between 0 and 1, neither included, from the MD5 of the seed and the ids as text; nulls count as such."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n")) for c in ids])
    whole = F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("double")
    return (whole + 0.5) / float(1 << BITS)


def weighted_sample(df: DataFrame, strata: list[str], weight: str, size: int, ids: list[str], seed: int = 0, chances: bool = False) -> DataFrame:
    """``df``'s sampled rows with ``drawn``, their place in the order of draws from 1 within the stratum; with ``chance`` if asked."""
    if size < 1:
        raise ValueError("the size of a sample has to be 1 or more")
    made = ["drawn", "chance"][: 1 + chances]
    if taken := {c.lower() for c in df.columns} & {*made, "_wait", "_row", "_lane"}:
        raise ValueError(f"columns of these names are made here: {', '.join(sorted(taken))}")
    names, w = [F.col(f"`{c}`") for c in df.columns], F.col(f"`{weight}`").cast("double")
    rows = df.filter((w > 0) & (w < float("inf")) & ~F.isnan(w)).select(*names, (-F.ln(uniform([F.col(f"`{c}`") for c in ids], seed)) / w).alias("_wait"), F.xxhash64(*names).alias("_row"), (F.spark_partition_id() % LANES).alias("_lane"))
    by = [F.col(f"`{c}`") for c in strata]
    order, want, conf = ["_wait", "_row"], size + chances, df.sparkSession.conf
    if want > int(conf.get(THRESHOLD)):
        conf.set(THRESHOLD, want)
    lane = Window.partitionBy(*by, "_lane").orderBy(*order)
    rows = rows.withColumn("drawn", F.row_number().over(lane)).filter(F.col("drawn") <= want).drop("drawn")
    rows = rows.withColumn("drawn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("drawn") <= want)
    if chances:
        left_out = F.max(F.when(F.col("drawn") == size + 1, F.col("_wait"))).over(Window.partitionBy(*by))
        rows = rows.withColumn("chance", F.coalesce(-F.expm1(-w * left_out), F.lit(1.0))).filter(F.col("drawn") <= size)
    return rows.select(*names, *made)
