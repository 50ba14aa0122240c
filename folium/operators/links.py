"""Extension: links between pages, and metrics of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKDOWN = r"\[[^\]]*\]\(([^)\s#]+)[^)]*\)"
HREF = r"<a\s[^>]*href=\"([^\"]*)\""


def html_links(pages: DataFrame) -> DataFrame:
    """page_id, target of each link of an HTML page."""
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("target"))


def page_links(pages: DataFrame) -> DataFrame:
    """path, target of each Markdown link to a page, relative to the page's directory."""
    found = pages.select("path", F.explode(F.regexp_extract_all("content", F.lit(MARKDOWN), F.lit(1))).alias("to"))
    found = found.filter(F.col("to").endswith(".md") & ~F.col("to").contains("://"))
    directory = F.regexp_extract("path", "^(.*/)?[^/]*$", 1)
    joined = F.when(F.col("to").startswith("/"), F.substr("to", F.lit(2))).otherwise(F.concat(directory, F.col("to")))
    return found.select("path", F.regexp_replace(joined, r"(^|/)\./", "$1").alias("target"))


def most_linked(found: DataFrame) -> DataFrame:
    return found.groupBy("target").agg(F.count("*").alias("n_links"), F.count_distinct(F.col(found.columns[0])).alias("n_pages"))


def orphans(pages: DataFrame) -> DataFrame:
    """Pages that no other page links to, but for the index and the log."""
    linked = page_links(pages).filter("path <> target").select(F.col("target").alias("path")).distinct()
    return pages.filter(~F.col("path").isin("index.md", "log.md")).select("path").join(linked, "path", "left_anti")


def with_field(pages: DataFrame, key: str, value: str) -> DataFrame:
    """Paths of pages whose front matter has the field with that value."""
    return front_matter(pages).filter(F.col("fields")[key] == value).select("path")


def front_matter(pages: DataFrame) -> DataFrame:
    """path and map of the "key: value" lines between two lines of --- at the page's top."""
    block = F.regexp_extract("content", r"\A---\n((?s:.*?))\n---(?:\n|\z)", 1)
    fields = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^[\w-]+\s*:"))
    pairs = F.transform(fields, lambda x: F.struct(F.regexp_extract(x, r"^([\w-]+)", 1).alias("k"), F.regexp_replace(x, r"^[\w-]+\s*:\s*|\s+$", "").alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return pages.select("path", F.map_from_entries(last).alias("fields"))
