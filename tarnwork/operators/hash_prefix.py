"""Shortest prefix of a seeded order that fills a quota, for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_DIGITS = 3


def priority(seed, *keys: Column) -> Column:
    """A pseudo-random order of keys under a seed, as 32 hex digits that any engine can compute."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws(":", seed.cast("string"), *[k.cast("string") for k in keys]))


def running_totals(rows: DataFrame, group: str, order: str, tie: str, weight: str) -> DataFrame:
    """``rows`` with ``before``: the weight of all rows of the group that precede in (order, tie).

    ``order`` is a hex digest. Totals of its first digits give every bucket its start, so no task ever sees more
    than one bucket, a 4096th of a group.
    """
    bucket = F.substring(order, 1, BUCKET_DIGITS)
    rows = rows.withColumn("_bucket", bucket)
    sums = rows.groupBy(group, "_bucket").agg(F.sum(weight).alias("_sum"))
    earlier = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(group, "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(group, "_bucket").orderBy(order, tie).rowsBetween(Window.unboundedPreceding, -1)
    full = rows.join(starts, [group, "_bucket"]).withColumn("before", F.col("_start") + F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return full.drop("_bucket", "_start")
