"""Device utilisation over a stream of trace events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def device_load(events: DataFrame, *, late: str = "5 days", window: str = "1 hour") -> DataFrame:
    """Busy microseconds and events per device and window of capture time; rows later than ``late`` are dropped by the watermark.

    Works on batch and streaming tables with trace_id, tid, event_id, dur, captured_at.
    Redelivered rows count once while the watermark remembers them.
    """
    at = F.col("captured_at").cast("timestamp")
    x = events.withColumn("captured_at", at).withWatermark("captured_at", late).dropDuplicates(["event_id", "captured_at"])
    return x.groupBy(F.window("captured_at", window).alias("w"), "trace_id", "tid").agg(
        F.sum("dur").alias("busy_us"), F.count(F.lit(1)).alias("n_events")
    ).select("trace_id", "tid", F.col("w.start").alias("window_start"), "busy_us", "n_events")
