"""Windowed aggregation of event streams; the same function serves batch tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_windows(events: DataFrame, ts: str = "ts", kind: str = "event_type", value: str = "value", length: str = "6 hours", slide: str = "2 hours", late: str = "1 day") -> DataFrame:
    """window_start, kind, n, total, mean in sliding event-time windows; on streams a watermark bounds the state."""
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if events.isStreaming:
        events = events.withWatermark(ts, late)
    g = events.groupBy(F.window(ts, length, slide).alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return g.select(F.col("w.start").alias("window_start"), kind, "n", "total", "mean")
