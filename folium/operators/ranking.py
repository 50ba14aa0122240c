"""Extension: BM25 and vector ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bm25(pages: DataFrame, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """path, score of pages that have a term. Each page's words are counted in its row: what is shuffled is a few counts a page."""
    words = F.regexp_extract_all(F.lower("content"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    count = lambda t: F.size(F.filter("w", lambda x: x == t))
    per_page = pages.select("path", words.alias("w")).select("path", F.size("w").alias("len"), *[count(t).alias(f"tf{i}") for i, t in enumerate(terms)])
    stats = per_page.agg(F.count("*").alias("docs"), F.avg(F.when(F.col("len") > 0, F.col("len"))).alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]).first()
    if not stats["docs"] or stats["mean"] is None:
        return per_page.select("path", F.lit(0.0).alias("score")).limit(0)
    norm = k1 * (1 - b + b * F.col("len") / stats["mean"])
    parts = []
    for i in range(len(terms)):
        idf = F.log(F.lit(1 + (stats["docs"] - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5)))
        parts.append(idf * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + norm))
    found = per_page.filter(" OR ".join(f"tf{i} > 0" for i in range(len(terms))))
    return found.select("path", sum(parts[1:], parts[0]).alias("score"))


def nearest(vectors: DataFrame, query: list[float], k: int = 10) -> DataFrame:
    """The k rows of (vec_id, embedding) of largest cosine with the query; a top-k report."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, c: a.cast("double") * c), F.lit(0.0), lambda t, v: t + v)
    e = F.col("embedding")
    cosine = dot(e, q) / F.sqrt(dot(e, e) * dot(q, q))
    return vectors.select("vec_id", cosine.alias("cosine")).orderBy(F.desc("cosine"), "vec_id").limit(k)
