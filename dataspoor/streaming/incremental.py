"""Incremental scans: files that arrive are scanned in micro-batches by the batch plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

FILES = "repo string, path string, text string, rev string"


def arriving(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (repo, path, text, rev) from Parquet files that come into a folder."""
    return spark.readStream.schema(FILES).parquet(folder)


def scan_to(files: DataFrame, scan: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> DataStreamWriter:
    """Findings of each micro-batch as Parquet, one folder a batch, so that a batch run twice is written once."""

    def run(batch: DataFrame, number: int) -> None:
        scan(batch.select("repo", "path", "text")).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def windowed_counts(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """(start, event_type, n) of a stream of events (ts, event_type), late ones waited for."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
