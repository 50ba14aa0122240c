"""Pages from folders of files, from Parquet, and from tables of documents, conversations and events."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.functions.text import one_kind_of_line_end
from folium.sources.schemas import PAGES


def read_parquet_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages as written by write_pages(): a filter by wiki_id prunes folders, one by path is pushed to the files."""
    return spark.read.schema(PAGES).parquet(path)


def write_pages(pages: DataFrame, path: str, mode: str = "overwrite") -> None:
    pages.select("wiki_id", "path", "content").repartition("wiki_id", F.pmod(F.xxhash64("path"), F.lit(64))).write.partitionBy("wiki_id").mode(mode).parquet(path)


def read_folder(spark: SparkSession, folder: str, wiki_id: str, keep_invalid: bool = False) -> DataFrame:
    """The .md files below a folder of the driver's file system, as pages.

    Names are listed here, since Spark's own listing hides those that begin with _ or . and drops empty files. Files
    that aren't UTF-8 are left out, or kept with null content. Line ends become LF.
    """
    root = Path(folder)
    rows = [(wiki_id, p.relative_to(root).as_posix(), p.read_bytes()) for p in sorted(root.rglob("*.md")) if p.is_file()]
    raw = spark.createDataFrame(rows, "wiki_id string, path string, bytes binary")
    valid = F.is_valid_utf8(F.col("bytes").cast("string"))
    content = F.when(valid, one_kind_of_line_end(F.col("bytes").cast("string")))
    pages = raw.select("wiki_id", "path", content.alias("content"))
    return pages if keep_invalid else pages.filter("content IS NOT NULL")


def read_files(spark: SparkSession, folder: str, wiki_id: str) -> DataFrame:
    """The .md files below a folder of any store, read by the executors. Spark's listing leaves out hidden names, names that
    begin with _ and empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(folder)
    text = F.col("content").cast("string")
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/") + "/"
    relative = F.substr("path", F.lit(len(root) + 1))
    return files.filter(F.is_valid_utf8(text)).select(F.lit(wiki_id).alias("wiki_id"), relative.alias("path"), one_kind_of_line_end(text).alias("content"))


def documents_as_pages(documents: DataFrame) -> DataFrame:
    """A page src/lang/id.md for each document; all are of wiki `main`."""
    path = F.concat_ws("/", F.col("source"), F.col("lang"), F.concat(F.col("doc_id").cast("string"), F.lit(".md")))
    return documents.select(F.lit("main").alias("wiki_id"), path.alias("path"), F.col("text").alias("content"))


def conversations_as_pages(conversations: DataFrame) -> DataFrame:
    """A page chats/id.md for each conversation, its turns in order under headings of their roles."""
    turn = F.struct("turn", F.concat(F.lit("## "), F.col("role"), F.lit("\n\n"), F.coalesce("text", F.lit(""))).alias("block"))
    pages = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    content = F.array_join(F.transform("turns", lambda t: t["block"]), "\n\n")
    path = F.concat(F.lit("chats/"), F.col("conv_id").cast("string"), F.lit(".md"))
    return pages.select(F.lit("main").alias("wiki_id"), path.alias("path"), content.alias("content"))


def events_as_log(events: DataFrame) -> DataFrame:
    return events.select(F.lit("main").alias("wiki_id"), "ts", F.col("event_type").alias("operation"), F.col("props").alias("entry"))


def events_as_versions(events: DataFrame) -> DataFrame:
    """Versions of a page per user: its content is the event's type, and an error deletes it."""
    path = F.concat(F.lit("users/"), F.col("user_id").cast("string"), F.lit(".md"))
    gone = F.col("event_type") == "error"
    op = F.when(gone, "delete_page").otherwise("write_page")
    return events.select(
        F.lit("main").alias("wiki_id"), path.alias("path"), F.col("event_id").alias("version"), "ts", op.alias("op"),
        F.concat(F.lit("wiki: "), op, F.lit(" wiki/"), path).alias("message"), F.when(~gone, F.col("event_type")).alias("content"), gone.alias("is_delete"),
    )
