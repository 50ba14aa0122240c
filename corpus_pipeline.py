"""A corpus pipeline: each stage's rows are written and read again as the next one's documents.

Every row is a document, whatever its doc_id: rows without one, or with the same one, are judged by their own texts.
All stages take whole texts of any length, keep extra columns, and give an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folium.llm import decontaminate, jaccard_join, language_id, mixing
from folium.llm.queries import fold, token_ids
from folium.llm.shared import release, table, written

#: Least share of a text's words that its language has. Of held-out documents about one in 1,000 is below; texts that switch
#: between two languages half and half, and texts in none that was learned, mostly are.
LEAST = 0.52


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language stay. Null texts and texts without letters go, as do texts of which no language has LEAST of
    the words: switching ones, junk, unknown languages. Repeated rows fare alike; a tie of two languages is below LEAST."""
    return language_id.accepted(docs, usable=fold(4) != 2, least=LEAST)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group that the n-gram Jaccard join connects: that of least doc_id, those without one last; of
    identical rows one. Null texts and texts without words are in no group and stay."""
    return jaccard_join.one_of_each(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go; null and empty texts have none. Repeated rows fare alike."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it; null texts and texts without words have no size, and a null
    source is a source. Identical rows tie and are taken one by one."""
    return mixing.repeated(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in files, and per document where its ids begin, their number and checksum. Null texts are empty; rows of equal
    doc_id are in order of their texts, those without one first."""
    return token_ids(docs)


STAGES = [
    ("language_id", language),
    ("jaccard_join", near_duplicates),
    ("decontaminate", clean_of_benchmark),
    ("mixing", mixed),
    ("token_ids", tokens),
]
#: Stages learn a language model and tokenize, which SQL can't express; the tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(but=docs)
    return docs
