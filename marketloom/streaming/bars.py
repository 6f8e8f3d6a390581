"""Bars and last values over event streams; the same functions serve batch frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
    ]
)


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of event files; event time is taken as UTC."""
    e = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, length: str, late: str = "10 minutes") -> DataFrame:
    """Open, high, low, close and count by user and window. Streams drop what is later than ``late``."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    at = F.struct("ts", "event_id")
    b = e.groupBy("user_id", F.window("ts", length).alias("w")).agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count(F.lit(1)).alias("n")
    )
    return b.select("user_id", F.col("w.start").alias("bucket"), "open", "high", "low", "close", "n")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Activity sessions that end after ``gap`` without an event."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    s = e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return s.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def last_values(events: DataFrame) -> DataFrame:
    """The newest value of each user and event type; in update mode a stream keeps one state row each."""
    return events.groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.max("ts").alias("ts"))
