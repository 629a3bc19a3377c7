"""Extension: the same column expressions over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A folder of event files as a stream, timestamps in the session's time zone."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per tumbling window and type; late rows are dropped by the watermark."""
    seen = events.withWatermark("ts", late) if events.isStreaming else events
    return seen.groupBy(F.window("ts", length).alias("w"), "event_type").agg(
        F.count("*").alias("n"), F.sum("value").alias("total")
    ).select(F.col("w.start").alias("start"), "event_type", "n", "total")
