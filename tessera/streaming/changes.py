"""The change feed of a store as a stream, and windows over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.store import FEED



def change_stream(spark: SparkSession, root: str, table: str | None = None) -> DataFrame:
    """Committed changes of a store's tables and definitions, each once; the commit moves them into the folder."""
    feed = spark.readStream.schema(FEED).parquet(f"{root.rstrip('/')}/_changes")
    return feed.where(F.col("table") == table) if table else feed


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events by tumbling window and type; events later than late are left out of closed windows."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = timed.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("v"))
    return grouped.select(F.col("window.start").alias("start"), "event_type", "n", "v")
