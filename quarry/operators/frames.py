"""Facts about DataFrames that operators plan by."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes, by the optimizer's estimate, up to which a side may be broadcast.
BROADCAST = 256 << 20


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a plan's size; unknown sizes are estimated as huge."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def small(df: DataFrame, most: int = BROADCAST) -> bool:
    """Whether the optimizer knows that a plan's result is small enough to be broadcast."""
    return estimated_bytes(df) <= most


def dealt(df: DataFrame, *keys: str, piece: int = 16 << 20, most: int = 2000) -> DataFrame:
    """``df`` dealt out by ``keys``, in as many pieces as Spark is set to and more for a large input (by the optimizer's estimate, some MB each)."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, min(most, estimated_bytes(df) // piece)), *keys)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``position`` from 0 in an order, by counts of range pieces instead of one sorted partition."""
    ranged = rows.repartitionByRange(*order).withColumn("__piece", F.spark_partition_id())
    counts = ranged.groupBy("__piece").count()
    starts = counts.select("__piece", F.coalesce(F.sum("count").over(Window.orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))  # one row a piece
    within = F.row_number().over(Window.partitionBy("__piece").orderBy(*order))
    return ranged.withColumn("__at", within).join(F.broadcast(starts), "__piece").withColumn("position", F.col("__start") + F.col("__at") - 1).drop("__piece", "__at", "__start")
