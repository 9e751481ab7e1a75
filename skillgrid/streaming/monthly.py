"""Counts over arriving events: tumbling windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LATENESS = "1 day"


def read_events(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder, of like's columns."""
    return spark.readStream.schema(like.schema).parquet(folder)


def counts(events: DataFrame, width: str = "1 hour", lateness: str = LATENESS) -> DataFrame:
    """(start, event_type, n, total) of each window of events (ts, event_type, value); works on streams, where
    a window closes once the watermark has passed it, and on tables."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)
    rows = timed.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n", "total")
