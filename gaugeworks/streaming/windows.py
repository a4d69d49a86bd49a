"""Windowed aggregates over a stream of events, with watermarks for late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())])


def read_events(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Events from Parquet files that arrive in a folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """(start, event_type, n, mean): closed windows only; events later than the watermark are dropped."""
    return _flat(events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")), "window")


def sliding(events: DataFrame, width: str = "7 days", step: str = "1 day", late: str = "1 day") -> DataFrame:
    return _flat(events.withWatermark("ts", late).groupBy(F.window("ts", width, step), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")), "window")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(start, user_id, n): a user's events with no longer gap between them."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return s.select(F.col("session_window.start").alias("start"), "user_id", "n")


def _flat(df: DataFrame, window: str) -> DataFrame:
    return df.select(F.col(f"{window}.start").alias("start"), "event_type", "n", "mean")


def run_available(df: DataFrame, out: str, checkpoint: str) -> None:
    """Process what has arrived and stop; a restart from the same checkpoint goes on where it ended."""
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
