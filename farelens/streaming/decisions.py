"""Streaming counterparts over the decision log (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def event_stream(spark: SparkSession, folder: str, schema: str | StructType) -> DataFrame:
    """A stream of the event files of a folder, with an event time that watermarks accept."""
    given = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    return given.withColumn("event_time", F.col("ts").cast("timestamp"))


def windowed_accept_rate(events: DataFrame, window: str = "1 day", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Decisions and acceptance per event-time window; works on streams and tables alike."""
    w = F.window("event_time", window, slide) if slide else F.window("event_time", window)
    out = events.withWatermark("event_time", late).groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.sum((F.col("event_type") == "purchase").cast("long")).alias("accepted"))
    return out.select(F.col("w.start").alias("window_start"), "n", "accepted")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Per rider the sessions of decisions no further apart than the gap."""
    return events.withWatermark("event_time", late).groupBy(F.session_window("event_time", gap).alias("s"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("session_start"), "n")


def drain(spark: SparkSession, stream: DataFrame, checkpoint: str, target: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there into a Parquet folder and reads it back."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", target).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(target)
