"""Trace events as a stream: late events are waited for, latest ones are kept by type, elapsed times come from the first one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_at_once).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def counts_by_window(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their mean value for each window and type; a window is final once it is `late` past."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select("window.start", "window.end", "event_type", "n", "mean_value")


def latest_by_type(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """The value of the last event of each user and type in each window: an aggregate whose state the watermark bounds."""
    last = F.max_by("value", F.struct("ts", "event_id"))
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "user_id", "event_type").agg(last.alias("value"), F.max("ts").alias("at")).select("window.start", "user_id", "event_type", "value", "at")


def once(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events without those delivered again within `late`."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def run_to_end(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Writes all that is there now to a table and stops; the next call goes on from the checkpoint."""
    rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path).awaitTermination()
