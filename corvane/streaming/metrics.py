"""Sum-reducible metrics over tumbling windows of a stream: the same aggregates as in batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, time: str, width: str, metrics: dict[str, Column], late: str = "1 hour", by: list[str] | None = None) -> DataFrame:
    """events (a stream or a table) aggregated by tumbling windows; rows later than the watermark are dropped by a stream.

    Exact distinct counts can't be merged window by window: use approx_count_distinct in their place.
    """
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, late) if events.isStreaming else rows
    grouped = rows.groupBy(F.window(time, width).alias("_w"), *(by or [])).agg(*(c.alias(k) for k, c in metrics.items()))
    return grouped.select(F.col("_w.start").alias("window_start"), *(by or []), *metrics)


def run_once(frame: DataFrame, name: str, checkpoint: str, mode: str = "complete"):
    """Runs a stream over what is there now into a table in memory, for tests and backfills."""
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return frame.sparkSession.table(name)
