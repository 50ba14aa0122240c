"""Literal line search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folium.functions import paths, text
from folium.operators.pages import numbered_lines


def search_lines(pages: DataFrame, query: str, case_sensitive: bool = False) -> DataFrame:
    """path, line_number, line of each line of a visible page that has the query; once, however often.

    Pages without the query are dropped before lines are made. A query with a line end is in no line.
    """
    if text.spans_lines(query):
        return numbered_lines(pages.limit(0))
    found = pages.filter(paths.is_listed(F.col("path")) & F.col("content").isNotNull())
    found = found.filter(text.contains(F.col("content"), query, case_sensitive))
    return numbered_lines(found).filter(text.contains(F.col("line"), query, case_sensitive))


def search(pages: DataFrame, query: str, case_sensitive: bool = False) -> DataFrame:
    """path, matches array<struct<line_number, line>> by number; pages in the order of their path's components."""
    hits = search_lines(pages, query, case_sensitive)
    matches = F.array_sort(F.collect_list(F.struct("line_number", "line"))).alias("matches")
    return hits.groupBy("path").agg(matches).orderBy(paths.component_order(F.col("path")))


def first_matches(hits: DataFrame, most: int = 5) -> DataFrame:
    """The first `most` lines of each page, and how many more it has."""
    by_page = Window.partitionBy("path")
    ranked = hits.withColumn("rank", F.row_number().over(by_page.orderBy("line_number"))).withColumn("more", F.greatest(F.count("*").over(by_page) - most, F.lit(0)))
    return ranked.filter(F.col("rank") <= most).drop("rank")


def match_counts(hits: DataFrame, shown: int = 5) -> DataFrame:
    counts = hits.groupBy("path").agg(F.count("*").alias("n_matches"), F.min("line_number").alias("first_line"))
    return counts.withColumn("more", F.greatest(F.col("n_matches") - shown, F.lit(0)))


def web_rows(pages: DataFrame, query: str | None, base_url: str, token: str = "", most: int = 5) -> DataFrame:
    """What the reader's search page shows: path, title, url, line_number, line of the first `most` lines of each page, and how
    many more it has. The query is stripped, and a blank one finds nothing."""
    query = (query or "").strip()
    hits = first_matches(search_lines(pages if query else pages.limit(0), query), most)
    url = F.concat(F.lit(base_url.rstrip("/") + "/"), "path", F.lit(f"?token={token}" if token else ""))
    return hits.select("path", paths.label(F.col("path")).alias("title"), url.alias("url"), "line_number", "line", "more")


def web_search(pages: DataFrame, query: str | None) -> DataFrame | None:
    """As the reader's search box: the query is stripped, and a blank one is no search."""
    query = (query or "").strip()
    return search(pages, query) if query else None
