"""Bars from a stream of events, by the same definition as the batch view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bars_from_stream(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """symbol, bar_ts, open, high, low, close, volume for each closed window; events later than the watermark are left out."""
    df = events.filter("value > 0").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    bars = df.groupBy(F.col("event_type").alias("symbol"), F.window("ts", width).alias("w")).agg(
        F.min_by("value", "event_id").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "event_id").alias("close"), F.count("*").cast("double").alias("volume")
    )
    return bars.select("symbol", F.col("w.start").alias("bar_ts"), "open", "high", "low", "close", "volume")
