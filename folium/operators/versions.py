"""Writes as an append-only table of versions, from which the current pages follow.

A version is numbered by (ts, version): one writer, or any tie-break, must make that pair unique per page.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folium.functions import paths
from folium.functions.text import lines
from folium.sources.schemas import VERSIONS


# Fixed value: the message of a commit.
MESSAGE = "wiki: {op} wiki/{path}"


def message(op: str, path: str) -> str:
    return MESSAGE.format(op=op, path=path)


def version(spark: SparkSession, wiki_id: str, path: str, content: str | None, ts: datetime.datetime, number: int, op: str = "write_page") -> DataFrame:
    """The row that writing a page (or, with null content, deleting it) appends."""
    path = paths.checked(path)
    if content is None and path in (paths.INDEX, paths.LOG):
        raise PermissionError(f"Cannot delete protected page: {path}")
    return spark.createDataFrame([(wiki_id, path, number, ts, op, message(op, path), content, content is None)], VERSIONS)


def bulk_writes(rows: DataFrame, op: str = "write_page") -> DataFrame:
    """Versions from (wiki_id, path, version, ts, content); rows with invalid paths, and deletions of protected pages, are left out."""
    gone = F.col("content").isNull()
    good = rows.filter(paths.is_valid(F.col("path")) & ~(gone & paths.is_protected(F.col("path"))))
    name = F.when(gone, "delete_page").otherwise(op)
    return good.select("wiki_id", "path", "version", "ts", name.alias("op"), F.concat(F.lit("wiki: "), name, F.lit(" wiki/"), F.col("path")).alias("message"), "content", gone.alias("is_delete"))


def order() -> Column:
    return F.struct("ts", "version")


def latest(versions: DataFrame) -> DataFrame:
    """The current pages: each one's last version, unless it deletes. One partial aggregate per page, no sort."""
    last = versions.groupBy("wiki_id", "path").agg(F.max_by(F.struct("content", "is_delete"), order()).alias("last"))
    return last.filter("NOT last.is_delete").select("wiki_id", "path", "last.content")


def commits(versions: DataFrame) -> DataFrame:
    """Versions that change something: a page's first one unless it deletes, then those that differ from the one before."""
    w = Window.partitionBy("wiki_id", "path").orderBy("ts", "version")
    before = F.lag(F.struct("content", "is_delete")).over(w)
    df = versions.withColumn("before", before)
    same = F.col("before").isNotNull() & F.col("before.content").eqNullSafe(F.col("content")) & (F.col("before.is_delete") == F.col("is_delete"))
    return df.filter(~same & ~(F.col("before").isNull() & F.col("is_delete"))).drop("before")


def history(versions: DataFrame, path: str) -> DataFrame:
    """A page's commits, newest first."""
    found = commits(versions.filter(F.col("path") == paths.checked(path)))
    return found.select("wiki_id", "ts", "version", "op", "message", "content").orderBy(F.desc("ts"), F.desc("version"))


def line_changes(versions: DataFrame) -> DataFrame:
    """Per commit the numbers of lines that it adds and removes, as multisets of lines."""
    keys = ["wiki_id", "path", "ts", "version"]
    w = Window.partitionBy("wiki_id", "path").orderBy("ts", "version")
    df = commits(versions).withColumn("new", lines(F.coalesce("content", F.lit("")))).withColumn("old", F.coalesce(F.lag("new").over(w), F.array().cast("array<string>")))
    signed = lambda c, n: F.transform(c, lambda x: F.struct(x.alias("line"), F.lit(n).alias("n")))
    itself = F.array(F.struct(F.lit(None).cast("string").alias("line"), F.lit(0).alias("n")))  # for commits without lines
    each = df.select(*keys, F.explode(F.concat(itself, signed(F.col("new"), 1), signed(F.col("old"), -1))).alias("l"))
    net = each.groupBy(*keys, "l.line").agg(F.sum("l.n").alias("n"))
    return net.groupBy(*keys).agg(F.sum(F.greatest("n", F.lit(0))).cast("int").alias("lines_added"), F.sum(F.greatest(-F.col("n"), F.lit(0))).cast("int").alias("lines_removed"))


# The pages of a fresh corpus.
SCAFFOLD = {
    paths.INDEX: "# Wiki Index\n\nThis is the master catalog of all pages in this wiki.\nUpdate it whenever you create or significantly modify a page.\n",
    paths.LOG: "# Activity Log\n\n",
}


def scaffold(spark: SparkSession, pages: DataFrame, wiki_id: str, ts: datetime.datetime, number: int = 0) -> DataFrame:
    """Versions that add the pages of SCAFFOLD which the wiki doesn't have."""
    rows = [(wiki_id, p, number, ts, "scaffold", "wiki: initial commit", c, False) for p, c in SCAFFOLD.items()]
    return spark.createDataFrame(rows, VERSIONS).join(pages.select("wiki_id", "path"), ["wiki_id", "path"], "left_anti").select(*[c.split()[0] for c in VERSIONS.split(", ")])
