"""Counts of log entries as they arrive, and appending them to the log's table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folium.sources.schemas import LOG


def read_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Entries from Parquet files as they are added to a folder."""
    return spark.readStream.schema(LOG).parquet(folder)


def windowed_counts(entries: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Entries per wiki, operation and tumbling window; a window is final once the watermark, `late` behind, has passed it."""
    counts = entries.withWatermark("ts", late).groupBy("wiki_id", "operation", F.window("ts", width)).agg(F.count("*").alias("n_entries"))
    return counts.select("wiki_id", "operation", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n_entries")


def append(entries: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Appends what is there to the table, exactly once, and stops."""
    return entries.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
