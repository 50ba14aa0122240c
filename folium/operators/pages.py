"""Listing, reading and describing pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.functions import paths, text


def list_pages(pages: DataFrame, subdirectory: str | None = None) -> DataFrame:
    """Paths of the visible pages, as strings in order; of one directory if given. Contents aren't read."""
    found = pages.filter(paths.is_listed(F.col("path")))
    if subdirectory:
        found = found.filter(paths.is_below(F.col("path"), subdirectory))
    return found.select("path").orderBy("path")


def page(pages: DataFrame, path: str) -> DataFrame:
    """The row of one page, none if there is no such page."""
    return pages.filter(F.col("path") == paths.checked(path)).select("path", "content")


def read_page(pages: DataFrame, path: str) -> str:
    """A page's content; FileNotFoundError if it is missing, UnicodeDecodeError if it isn't text."""
    rows = page(pages, path).take(1)
    if not rows:
        raise FileNotFoundError(f"Page not found: {path}")
    if rows[0].content is None:
        raise UnicodeDecodeError("utf-8", b"", 0, 1, f"page {path} isn't valid UTF-8")
    return rows[0].content


def read_index(pages: DataFrame) -> str:
    return read_page(pages, paths.INDEX)


def log_entries_in(content: Column) -> Column:
    """Lines that begin with "## ": headings, and lines within entries that look like them."""
    return F.coalesce(F.regexp_count(content, F.lit("(?m)^## ")), F.lit(0)).cast("long")


def wiki_info(pages: DataFrame, root: str, schema: str = "") -> DataFrame:
    """page_count (.md files not named log.md, hidden ones included), log_entries (of log.md), wiki_root, schema: one row."""
    is_page = paths.is_page(F.col("path")) & (paths.name(F.col("path")) != paths.LOG)
    log = F.when(F.col("path") == paths.LOG, log_entries_in(F.col("content")))
    return pages.agg(
        F.count_if(is_page).alias("page_count"), F.coalesce(F.sum(log), F.lit(0)).cast("long").alias("log_entries"),
    ).select("page_count", "log_entries", F.lit(root).alias("wiki_root"), F.lit(schema).alias("schema"))


def page_counts(pages: DataFrame) -> DataFrame:
    """Pages of each wiki, log and hidden ones included."""
    return pages.filter(paths.is_page(F.col("path"))).groupBy("wiki_id").agg(F.count("*").alias("page_count"))


def page_tree(pages: DataFrame, base_url: str, token: str = "") -> DataFrame:
    """path, label, depth, url of each visible page, in order."""
    p = F.col("path")
    query = f"?token={token}" if token else ""
    url = F.concat(F.lit(base_url.rstrip("/") + "/"), p, F.lit(query))
    return pages.filter(paths.is_listed(p)).select(p, paths.label(p).alias("label"), paths.depth(p).alias("depth"), url.alias("url")).orderBy("path")


def with_breadcrumbs(pages: DataFrame, home_url: str) -> DataFrame:
    return pages.select("path", paths.breadcrumbs(F.col("path"), F.lit(home_url)).alias("breadcrumbs"))


def with_title(pages: DataFrame) -> DataFrame:
    return pages.select("path", paths.label(F.col("path")).alias("title"))


def numbered_lines(pages: DataFrame) -> DataFrame:
    """path, line_number from 1, line."""
    return pages.select("path", F.posexplode(text.lines(F.col("content"))).alias("at", "line")).select("path", (F.col("at") + 1).alias("line_number"), "line")
