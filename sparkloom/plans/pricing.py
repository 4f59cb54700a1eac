"""Pricing summary over lineitem: the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by return flag and line status.

    Money is summed as decimals, so the result doesn't depend on how Spark
    splits the rows. One partial aggregation, then a shuffle of a few groups.
    """
    cents = lambda c: F.col(c).cast("decimal(12,2)")
    return (
        spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        .filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.sum(cents("l_quantity")).cast("double").alias("sum_qty"),
            F.sum(cents("l_extendedprice")).cast("double").alias("sum_base_price"),
            F.sum(cents("l_extendedprice") * (1 - cents("l_discount"))).cast("double").alias("sum_disc_price"),
            F.count(F.lit(1)).alias("count_order"),
        )
    )


QUERIES = {"pricing_summary": pricing_summary}
SQL = {
    "pricing_summary": """
        SELECT l_returnflag, l_linestatus,
               CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS sum_qty,
               CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS sum_base_price,
               CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(12,2)))) AS DOUBLE) AS sum_disc_price,
               count(*) AS count_order
        FROM lineitem
        WHERE l_shipdate <= TIMESTAMP '1998-09-02'
        GROUP BY l_returnflag, l_linestatus
    """
}
