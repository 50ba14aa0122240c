"""The activity log: an append-only table, rendered to Markdown when asked."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.functions.text import stripped, utc_text
from folium.sources.schemas import LOG

# Fixed value: how the log's page begins.
HEAD = "# Activity Log\n\n"


def entry(spark: SparkSession, wiki_id: str, ts: datetime.datetime, text: str, operation: str | None = None) -> DataFrame:
    """The row that an entry appends. The time is the caller's, so that a retried job writes the same."""
    return spark.createDataFrame([(wiki_id, ts, operation or None, text.strip())], LOG)


def heading() -> Column:
    named = F.coalesce(F.col("operation"), F.lit("")) != ""
    return F.concat(F.lit("## "), utc_text(F.col("ts")), F.when(named, F.concat(F.lit(" ["), F.col("operation"), F.lit("]"))).otherwise(""))


def commit_message() -> Column:
    named = F.when(F.coalesce(F.col("operation"), F.lit("")) != "", F.col("operation")).otherwise("log")
    return F.concat(F.lit("wiki: append_log "), named, F.lit(" "), utc_text(F.col("ts")))


def rendered(log: DataFrame) -> DataFrame:
    """heading, block (as appended to the log's page) and commit message of each entry."""
    block = F.concat(F.lit("\n"), heading(), F.lit("\n\n"), stripped(F.coalesce("entry", F.lit(""))), F.lit("\n"))
    return log.select("wiki_id", "ts", "operation", heading().alias("heading"), block.alias("block"), commit_message().alias("message"))


def log_page(log: DataFrame, written: DataFrame | None = None) -> DataFrame:
    """The log's page of each wiki. A wiki's entries are put in one text, so this is for logs of readable size.

    written (wiki_id, content, since): pages that were written, to which only entries from then on are appended.
    """
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("ts", "block"))), lambda b: b["block"])
    if written is None:
        pages = rendered(log).groupBy("wiki_id").agg(blocks.alias("blocks")).withColumn("content", F.lit(HEAD))
    else:
        later = rendered(log).join(written.select("wiki_id", "since"), "wiki_id", "left").filter("since IS NULL OR ts >= since")
        pages = later.groupBy("wiki_id").agg(blocks.alias("blocks")).join(written.select("wiki_id", "content"), "wiki_id", "full")
    return pages.select("wiki_id", F.lit("log.md").alias("path"), F.concat(F.coalesce("content", F.lit(HEAD)), F.coalesce(F.array_join("blocks", ""), F.lit(""))).alias("content"))


def counts(log: DataFrame) -> DataFrame:
    """Entries by operation, with the first and last time."""
    return log.groupBy("wiki_id", "operation").agg(F.count("*").alias("n_entries"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def per_day(log: DataFrame) -> DataFrame:
    return log.groupBy("wiki_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n_entries"))
