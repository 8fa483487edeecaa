"""Incremental ingest and, beyond batch, windows over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def to_process(current: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Rows whose ``(key, content hash, code version)`` the manifest lacks."""
    return current.join(manifest.select(key, "content_hash", "code_version"), [key, "content_hash", "code_version"], "left_anti")


def status_counts(rows: DataFrame, statuses: list[str]) -> DataFrame:
    """``(status, n)`` for every status, zero where none."""
    spark = rows.sparkSession
    every = spark.createDataFrame([(s,) for s in statuses], "status string")
    return every.join(rows.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def event_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet", files_per_trigger: int = 1) -> DataFrame:
    """The event files of a folder as a stream."""
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and value of each event type in tumbling windows; state is dropped behind the watermark."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def distinct_events(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """First of the events that repeat an id within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there, once, into parquet with exactly-once files."""
    df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
