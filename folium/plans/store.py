"""The nine operations over tables in a folder, and their text forms for clients.

versions/ and log/ are append-only Parquet tables partitioned by wiki_id, so that an operation on one wiki reads its
folder only. There is one writer per
wiki: version numbers count that wiki's versions.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from folium.functions import paths
from folium.operators import log as logs
from folium.operators import pages, search, versions
from folium.sources.corpus import write_pages
from folium.sources.schemas import LOG, VERSIONS


# What clients are told.
INDEX_UPDATED = "index.md updated successfully."
PAGE_WRITTEN = "Page '{}' written successfully."
PAGE_DELETED = "Page '{}' deleted successfully."
LOG_APPENDED = "Log entry appended successfully."
NO_PAGES, NO_MATCHES = "No pages found.", "No matches found."
ERROR = "Error: {}"
INFO = "Wiki root: {}\nPages: {}\nLog entries: {}"
GUIDE_HEAD = "--- Wiki Schema & Workflow Instructions ---"
RESULT_HEAD, RESULT_LINE = "### {}", "  Line {}: {}"


def utc_now() -> datetime.datetime:
    return datetime.datetime.now(datetime.UTC).replace(tzinfo=None)


class Corpus:
    def __init__(self, spark: SparkSession, folder: str, wiki_id: str, guide: str = "", now: Callable[[], datetime.datetime] = utc_now):
        self.spark, self.folder, self.wiki_id, self.guide, self.now = spark, folder.rstrip("/"), wiki_id, guide, now

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            rows = self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)
        return rows.filter(F.col("wiki_id") == self.wiki_id)

    def _append(self, rows: DataFrame, name: str) -> None:
        rows.coalesce(1).write.partitionBy("wiki_id").mode("append").parquet(f"{self.folder}/{name}")

    @property
    def versions(self) -> DataFrame:
        return self._table("versions", VERSIONS)

    @property
    def log(self) -> DataFrame:
        return self._table("log", LOG)

    @property
    def pages(self) -> DataFrame:
        """The current pages. The log's page is its last written version, or a fresh one, followed by the entries since, those
        of the same time included."""
        all_ = self.versions
        current = versions.latest(all_)
        written = all_.filter(F.col("path") == paths.LOG).groupBy("wiki_id").agg(F.max_by(F.struct("content", "ts"), versions.order()).alias("last"))
        return current.filter(F.col("path") != paths.LOG).unionByName(logs.log_page(self.log, written.select("wiki_id", "last.content", F.col("last.ts").alias("since"))))

    def _write(self, path: str, content: str | None, op: str) -> None:
        path = paths.checked(path)
        row = self.versions.agg(F.coalesce(F.max("version"), F.lit(0)).alias("n"), F.max_by(F.when(F.col("path") == path, F.struct("content", "is_delete")), F.when(F.col("path") == path, versions.order())).alias("last")).first()
        if content is not None and row["last"] is not None and not row["last"]["is_delete"] and row["last"]["content"] == content:
            return  # nothing changes, so there is no version
        self._append(versions.version(self.spark, self.wiki_id, path, content, self.now(), row["n"] + 1, op), "versions")

    def init(self) -> None:
        """Adds the pages of a fresh corpus that are missing."""
        self._append(versions.scaffold(self.spark, versions.latest(self.versions), self.wiki_id, self.now()), "versions")

    def wiki_info(self) -> Row:
        return pages.wiki_info(self.pages, f"{self.folder}#{self.wiki_id}", self.guide).first()

    def read_index(self) -> str:
        return pages.read_index(self.pages)

    def update_index(self, content: str) -> None:
        self._write(paths.INDEX, content, "update_index")

    def write_page(self, path: str, content: str) -> None:
        self._write(path, content, "write_page")

    def read_page(self, path: str) -> str:
        return pages.read_page(self.pages, path)

    def list_pages(self, subdirectory: str | None = None) -> list[str]:
        return [r.path for r in pages.list_pages(self.pages, subdirectory or None).collect()]

    def search_wiki(self, query: str, case_sensitive: bool = False) -> list[Row]:
        return search.search(self.pages, query, case_sensitive).collect()

    def append_log(self, entry: str, operation: str | None = None) -> None:
        self._append(logs.entry(self.spark, self.wiki_id, self.now(), entry, operation), "log")

    def delete_page(self, path: str) -> None:
        if paths.checked(path) in (paths.INDEX, paths.LOG):
            raise PermissionError(f"Cannot delete protected page: {path}")
        self.read_page(path)
        self._write(path, None, "delete_page")

    def compact(self) -> None:
        """Writes the current pages to pages/, for readers of read_parquet_pages(); operations here go on reading versions."""
        write_pages(self.pages, f"{self.folder}/pages")


class Tools:
    """The operations for clients that want text: errors become "Error: ..."."""

    def __init__(self, corpus: Corpus):
        self.corpus = corpus

    def _said(self, work: Callable[[], str]) -> str:
        try:
            return work()
        except Exception as e:  # noqa: BLE001  a client gets every error as text
            return ERROR.format(e)

    def _done(self, work: Callable[[], None], text: str) -> str:
        return self._said(lambda: (work(), text)[1])

    def wiki_info(self) -> str:
        return self._said(lambda: info_text(self.corpus.wiki_info()))

    def read_index(self) -> str:
        return self._said(self.corpus.read_index)

    def update_index(self, content: str) -> str:
        return self._done(lambda: self.corpus.update_index(content), INDEX_UPDATED)

    def write_page(self, path: str, content: str) -> str:
        return self._done(lambda: self.corpus.write_page(path, content), PAGE_WRITTEN.format(path))

    def read_page(self, path: str) -> str:
        return self._said(lambda: self.corpus.read_page(path))

    def list_pages(self, subdirectory: str = "") -> str:
        return self._said(lambda: "\n".join(self.corpus.list_pages(subdirectory)) or NO_PAGES)

    def search_wiki(self, query: str, case_sensitive: bool = False) -> str:
        return self._said(lambda: search_text(self.corpus.search_wiki(query, case_sensitive)))

    def append_log(self, entry: str, operation: str = "") -> str:
        return self._done(lambda: self.corpus.append_log(entry, operation), LOG_APPENDED)

    def delete_page(self, path: str) -> str:
        return self._done(lambda: self.corpus.delete_page(path), PAGE_DELETED.format(path))


def info_text(info: Row) -> str:
    head = INFO.format(info.wiki_root, info.page_count, info.log_entries)
    return f"{head}\n\n{GUIDE_HEAD}\n{info.schema}" if info.schema else head


def search_text(found: list[Row]) -> str:
    lines = [[RESULT_HEAD.format(r.path), *(RESULT_LINE.format(m.line_number, m.line) for m in r.matches)] for r in found]
    return "\n".join(x for page in lines for x in page) or NO_MATCHES
