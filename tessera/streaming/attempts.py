"""Attempt events folded to unit state as a stream (an extension; the batch form is operators.state)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attempt_counts(events: DataFrame, key: str = "user_id", ts: str = "ts", late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Attempts, failures and the last value of each unit by day, from a stream or a table of events."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark(ts, late)
    out = rows.groupBy(F.window(ts, window).alias("w"), key).agg(F.count("*").alias("attempts"), F.count_if(F.col("event_type") == "error").alias("failures"), F.max_by("value", ts).alias("last_value"))
    return out.select(key, F.col("w.start").alias("day"), "attempts", "failures", "last_value")


def run_stream(events: DataFrame, path: str, checkpoint: str, **k):
    """Write finished days as Parquet; returns the query."""
    return attempt_counts(events, **k).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
