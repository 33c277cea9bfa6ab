"""Exact order statistics of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..core.session import materialise

#: Bins of one group's range.
BINS = 4096


def medians(df: DataFrame, key: str, value: str) -> DataFrame:
    """(``key``, ``median``) of finite values, the mean of the two middle ones for an even number.

    A histogram tells the bins that hold the middle ranks; only the values in those are counted and ranked, so no
    task sees a group's values as a whole. Null values do not count; a group of none has no row.
    """
    v = df.select(key, F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    ends = materialise(v.groupBy(key).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n")), "median-ends")
    share = F.coalesce(F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    binned = v.join(F.broadcast(ends) if ends.count() <= 100_000 else ends, key).withColumn("bin", F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("int"))
    bins = binned.groupBy(key, "bin").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy(key).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    placed = bins.withColumn("start", F.coalesce(F.sum("c").over(before), F.lit(0))).join(ends.select(key, "n"), key)
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    middle = materialise(placed.where((F.col("start") <= high) & (F.col("start") + F.col("c") > low)).select(key, "bin", "start", low.alias("low"), high.alias("high")), "median-bins")
    # at most two bins for each group
    near = binned.join(F.broadcast(middle) if middle.count() <= 100_000 else middle, [key, "bin"]).groupBy(key, "bin", "start", "low", "high", "v").agg(F.count(F.lit(1)).alias("c"))
    above = Window.partitionBy(key, "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    at = near.withColumn("first", F.col("start") + F.coalesce(F.sum("c").over(above), F.lit(0)))
    holds = [(F.col("first") <= r) & (F.col("first") + F.col("c") > r) for r in (F.col("low"), F.col("high"))]
    return at.groupBy(key).agg(((F.max(F.when(holds[0], F.col("v"))) + F.max(F.when(holds[1], F.col("v")))) / 2).alias("median"))
