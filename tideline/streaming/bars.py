"""Bars of an event stream: a bar is emitted once the watermark has passed its end, so none is partial."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """A folder of Parquet files, or one file, as a stream, with ts as a timestamp."""
    pattern = f"{folder.rstrip('/')[:-1]}[{folder.rstrip('/')[-1]}]"  # the source takes a lone file only by a pattern
    return spark.readStream.schema(EVENTS).parquet(pattern).withColumn("ts", F.col("ts").cast("timestamp"))


def stream_bars(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    order = F.struct("ts", "event_id")
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), F.col("event_type").alias("ticker")).agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").cast("double").alias("volume")
    ).select(F.lit("event").alias("market"), "ticker", F.col("window.start").alias("date"), "open", "high", "low", "close", "volume")


def latest_values(events: DataFrame) -> DataFrame:
    """The last value of each type, kept current (update mode)."""
    return events.groupBy("event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.max("ts").alias("ts"))
