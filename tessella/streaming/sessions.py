"""Structured Streaming twins of the session operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session_windows(events: DataFrame, key: str, ts: str, gap: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions that end after a gap, with their event counts; events later than `late` are dropped. Works on streams and batches alike."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("events")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def deduplicated(events: DataFrame, key: str, ts: str, late: str = "1 hour") -> DataFrame:
    """Events without those whose key came before within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Work off what is there now and write it as Parquet, exactly once across restarts by the checkpoint."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()


def endless(spark: SparkSession, per_second: int = 10) -> DataFrame:
    """Scene indices without end, at a rate."""
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).load().select(F.col("value").alias("scene_index"), "timestamp")
