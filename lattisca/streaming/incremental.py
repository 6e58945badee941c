"""Collections that grow: event files as a stream, and aggregates that are kept up to date with bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """New Parquet files of a folder, as they come."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def counts_by_window(events: DataFrame, every: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, event_type, n, total) of each window; state older than the watermark goes."""
    kept = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    found = kept.groupBy(F.window("ts", every), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return found.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(user_id, start, n): runs of a user's events without a longer gap, the moving form of run splitting."""
    kept = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    found = kept.groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return found.select("user_id", F.col("session_window.start").alias("start"), "n")


def append_batches(stream: DataFrame, path: str, checkpoint: str):  # noqa: ANN201
    """Writes finished windows once, and ends when all files that are there have been read."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
