"""Event-time windows over streams; the same functions take a batch DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "1 hour", by: tuple[str, ...] = ("event_type",), ts: str = "ts") -> DataFrame:
    """(start, end, *by, n, total) of fixed or sliding windows; rows later than ``late`` behind the watermark are left to it."""
    source = events.withWatermark(ts, late) if events.isStreaming else events
    got = source.groupBy(F.window(ts, size, slide), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "total")


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "1 hour", user: str = "user_id", ts: str = "ts") -> DataFrame:
    """(user, start, end, n): runs of events of a user no further apart than ``gap``."""
    source = events.withWatermark(ts, late) if events.isStreaming else events
    got = source.groupBy(user, F.session_window(ts, gap)).agg(F.count("*").alias("n"))
    return got.select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def changes(store, name: str, since: int) -> DataFrame:
    """The change log of a managed table after a commit time, in the shape a sink applies by key."""
    return store.log(name).where(F.col("_commit_ts") > since)
