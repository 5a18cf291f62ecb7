"""Table statistics: distinct counts, histograms, null fractions, correlations and selectivity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def approx_ndv(rows: DataFrame, rsd: float = 0.01) -> DataFrame:
    """(column, ndv) by HyperLogLog."""
    got = rows.agg(*[F.approx_count_distinct(c, rsd).alias(c) for c in rows.columns])
    return got.unpivot([], got.columns, "column", "ndv")


def null_fraction(rows: DataFrame, columns: list[str]) -> DataFrame:
    got = rows.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return got.unpivot([], columns, "column", "fraction")


def histogram(rows: DataFrame, column: str, buckets: int = 100) -> DataFrame:
    """Equi-height buckets: (bucket, low, high, rows, distinct). Equal values are counted first and placed by running totals
    of range partitions, so no task sorts more than its own part of the distinct values."""
    freq = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    parts = freq.repartitionByRange("v").withColumn("p", F.spark_partition_id())
    sums = parts.groupBy("p").agg(F.sum("n").alias("s"))
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("p", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("start"), F.sum("s").over(Window.partitionBy(F.lit(1))).alias("total"))
    inside = Window.partitionBy("p").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.join(F.broadcast(starts), "p").withColumn("at", F.col("start") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    bucket = F.floor(F.col("at") * buckets / F.col("total")) + 1
    return placed.groupBy(bucket.cast("int").alias("bucket")).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("n").alias("rows"), F.count("*").alias("distinct"))


def correlations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) for every pair of columns; 0 where a column does not vary, 1 on the diagonal."""
    got = rows.agg(*[F.coalesce(F.corr(a, b), F.lit(0.0)).alias(f"{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j])
    flat = got.unpivot([], got.columns, "k", "r")
    name = lambda n: F.element_at(F.array(*map(F.lit, columns)), F.split_part("k", F.lit("_"), F.lit(n)).cast("int") + 1)
    pairs = flat.select(name(1).alias("a"), name(2).alias("b"), "r")
    own = rows.sparkSession.createDataFrame([(c, c, 1.0) for c in columns], pairs.schema)
    return pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "r")).union(own)


def sample(rows: DataFrame, key: str, n: int = 30_000, seed: int = 42) -> DataFrame:
    """n rows by the lowest seeded hash of their key, whatever the partitioning."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def equality_selectivity(hist: list, value, total: int, ndv: int | None = None) -> float:
    """Rows of the bucket over its distinct values, over all rows; 1/ndv without histogram, 0.01 without either."""
    for b in hist:
        if b.low <= value <= b.high:
            return b.rows / max(1, b.distinct) / total
    return 0.0 if hist else 1 / ndv if ndv else 0.01


def range_selectivity(hist: list, low, high, total: int) -> float:
    """Whole buckets inside the range and half of each that it cuts; 0.33 without histogram."""
    if not hist:
        return 0.33
    full = sum(b.rows for b in hist if low <= b.low and b.high <= high)
    cut = sum(b.rows for b in hist if not (low <= b.low and b.high <= high) and b.low <= high and b.high >= low)
    return min(1.0, (full + cut / 2) / total)
