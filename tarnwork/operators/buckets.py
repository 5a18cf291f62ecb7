"""Pairs inside buckets of candidates, without all pairs of a bucket and without a hot bucket in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 2048


def across(placed: DataFrame, comps: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows of ``placed`` (key, id, ...) that share a key but not a component, as pairs under the aliases ``l`` and ``r``.

    ``comps`` is (id, comp); rows without are their own component. In each bucket the members outside its largest component meet all
    members, so a bucket of one big component and few others costs their product, not the square of the bucket. A bucket's
    members are dealt into blocks of about ``block`` and the others are sent to each block, so no task holds a hot bucket.
    """
    kept = placed.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    parts = kept.groupBy("key", "comp").agg(F.count("*").alias("n"))
    total = parts.groupBy("key").agg(F.sum("n").alias("rows"), F.count("*").alias("comps"), F.max_by("comp", "n").alias("main"))
    mixed = total.where("comps > 1").select("key", "main", F.ceil(F.col("rows") / block).cast("int").alias("blocks"))
    inside = kept.join(mixed, "key")
    right = inside.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).alias("r")
    left = inside.where("comp <> main").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("l")
    return left.join(right, ["key", "block"]).where("l.comp <> r.comp and (r.comp = r.main or l.id < r.id)")
