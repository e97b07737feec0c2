"""Positions in a global order, without a single-task window.

The keys are dealt to ranges, as many as there are shuffle partitions. Any ranges give the same exact result; how even
they are only balances the work. Per-range totals (one row per range) give each range its offset, and the
window runs inside the ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.session import checkpoint_folder


def running_offset(df: DataFrame, key: str, weight: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``weight`` over all rows with a smaller ``key``. Keys are unique."""
    spark = df.sparkSession
    checkpoint_folder(spark)
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The number of a range is written with its rows, so totals and windows see the same ranges.
    ranged = df.repartitionByRange(ranges, key).withColumn("_range", F.spark_partition_id()).checkpoint()
    totals = ranged.groupBy("_range").agg(F.sum(weight).alias("_total"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_range", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    # One row per range, so the broadcast is bounded by the number of shuffle partitions.
    return (
        ranged.join(F.broadcast(starts), "_range")
        .withColumn(out, F.col("_start") + F.coalesce(F.sum(weight).over(inside), F.lit(0)))
        .drop("_range", "_start")
    )


def dense_ordinal(keys: DataFrame, key: str, out: str = "ordinal") -> DataFrame:
    """Number the distinct keys 0, 1, 2, ... in key order: ``(key, out)``."""
    unit = keys.select(key).distinct().withColumn("_one", F.lit(1).cast("bigint"))
    return running_offset(unit, key, "_one", out).select(key, out)
