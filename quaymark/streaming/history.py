"""Windowed counts and duplicate removal over recognition events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "1 hour", time: str = "created_at", key: str = "status") -> DataFrame:
    """(window_start, key, n): events in tumbling windows; rows later than `late` are dropped by the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")


def first_of_content(events: DataFrame, hash_col: str = "content_hash", late: str = "1 hour", time: str = "created_at") -> DataFrame:
    """Each content once while the watermark remembers it: the streaming kin of a result cache."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([hash_col])


def append(events: DataFrame, path: str, checkpoint: str):
    """Append micro-batches to a Parquet table; exactly once by the sink's own log."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
