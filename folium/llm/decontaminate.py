"""Benchmark decontamination by a prefix-filtered set join.

An item is cut to windows of 10 consecutive words, a window to shingles of 5. A window lies in a document only if all of
its shingles do, so one of them is a sufficient prefix; the rarest over all documents is taken, which gives the fewest
candidates. A place where a prefix shingle occurs fixes where its window would begin; bounds on that place and on the
length come first, then the words are compared. The documents' words are read once: the first pass keeps the places of
all benchmark shingles with the words about them, from which both the counts and the candidates are taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm.shared import kept, small, written

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, SHINGLE = 10, 5
#: Shingles and windows of a benchmark that may be broadcast; beyond, places are shuffled. Results are the same.
BENCHMARK_ROWS = 2_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str = "text") -> str:
    sep = SEPARATOR.replace("\\", "\\\\")
    return f"array_remove(split(translate(coalesce(CAST({text} AS string), ''), '{UPPER}', '{LOWER}'), '{sep}', -1), '')"


def windows_of(benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(win array<string>, items array<string>, width): the distinct windows, with the items that have them."""
    df = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.expr(words()).alias("w")).filter(F.size("w") > 0)
    df = df.select("item_id", F.expr(f"explode(transform(sequence(1, greatest(1, size(w) - {window - 1})), i -> slice(w, i, {window})))").alias("win"))
    return df.groupBy("win").agg(F.collect_set("item_id").alias("items")).withColumn("width", F.least(F.lit(shingle), F.size("win")))


#: What tells a row from others, but for identical ones: two hashes of its id and text.
KEY = ("xxhash64(doc_id, text) AS k1", "xxhash64(text, doc_id, 1) AS k2")


def places(docs: DataFrame, shingles: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """A row (doc_id, k1, k2, n_words) for each document; and a row (k1, k2, n_words, at, hash, about) for each place, from 1,
    of a benchmark shingle, with the words about it.

    Shingles of a benchmark of at most BENCHMARK_ROWS are looked up where the words are, in one pass. Beyond, only hashes and
    places are shuffled, and the words are fetched for places that are left.
    """
    widths = sorted(r[0] for r in shingles.select("width").distinct().collect())  # from 1 to SHINGLE
    df = docs.select("doc_id", *map(F.expr, KEY), F.expr(words()).alias("w"))
    each = [f"IF(size(w) < {k}, CAST(array() AS array<struct<at: int, hash: bigint>>), transform(sequence(1, greatest(1, size(w) - {k - 1})), i -> named_struct('at', i, 'hash', xxhash64(slice(w, i, {k})))))" for k in widths]
    known = shingles.select("hash").distinct()
    reach = window - 1
    about = f"slice(w, greatest(1, at - {reach}), {2 * window}) AS about"
    if known.limit(BENCHMARK_ROWS + 1).count() <= BENCHMARK_ROWS:
        none = "array(named_struct('at', 0, 'hash', CAST(NULL AS bigint)))"  # stands for the document itself
        df = df.withColumn("p", F.expr(f"explode(concat({', '.join([none, *each])}))")).select("doc_id", "k1", "k2", "w", "p.at", "p.hash")
        df = df.join(F.broadcast(known.withColumn("known", F.lit(True))), "hash", "left").filter("at = 0 OR known")
        found = kept(df.selectExpr("doc_id", "k1", "k2", "CAST(size(w) AS bigint) AS n_words", "at", "hash", f"IF(at = 0, NULL, {about.removesuffix(' AS about')}) AS about"))
        return found.filter("at = 0").select("doc_id", "k1", "k2", "n_words"), found.filter("at > 0").drop("doc_id")
    spots = df.select("k1", "k2", F.expr(f"explode({'concat(' + ', '.join(each) + ')'})").alias("p")).select("k1", "k2", "p.at", "p.hash").distinct()
    spots = written(spots.join(known, "hash", "left_semi"), "decontaminate-places")
    hits = df.drop("doc_id").join(spots, ["k1", "k2"]).selectExpr("k1", "k2", "CAST(size(w) AS bigint) AS n_words", "at", "hash", about)
    return df.selectExpr("doc_id", "k1", "k2", "CAST(size(w) AS bigint) AS n_words"), kept(hits)


def occurrences(docs: DataFrame, windows: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The documents as places() has them, and a row (k1, k2, start, length, items) for each place where a window occurs;
    start counts words from 0."""
    shingles = windows.select("win", "items", "width", F.expr("posexplode(transform(sequence(1, size(win) - width + 1), i -> xxhash64(slice(win, i, width))))").alias("off", "hash"))
    shingles = written(shingles, "decontaminate-shingles")
    every, hits = places(docs, shingles, window)
    counts = hits.groupBy("hash").count()
    rarest = shingles.join(counts, "hash", "left").groupBy("win").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "hash", "off", "items")).alias("r"))
    prefixes = written(rarest.select("win", "r.hash", "r.off", "r.items"), "decontaminate-prefixes")
    at = hits.join(small(prefixes, BENCHMARK_ROWS), "hash").selectExpr("*", "at - 1 - off AS start", "size(win) AS length")
    at = at.filter("start >= 0 AND start + length <= n_words")
    at = at.filter(f"slice(about, start + 2 - greatest(1, at - {window - 1}), length) = win")
    return every, at.select("k1", "k2", "start", "length", "items")


def contaminated(found: DataFrame) -> DataFrame:
    """Per key (k1, k2) with a hit: n_hit, item_ids."""
    df = found.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "length")).alias("hits"), F.collect_set("items").alias("items"))
    hit = """aggregate(sort_array(hits), named_struct('upto', 0, 'n', 0L),
        (a, h) -> named_struct('upto', greatest(a.upto, h.start + h.length), 'n', a.n + greatest(0, h.start + h.length - greatest(a.upto, h.start))), a -> a.n)"""
    return df.select("k1", "k2", F.expr(hit).alias("n_hit"), F.expr("sort_array(array_distinct(flatten(items)))").alias("item_ids"))


def _prepared(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, item_ids (sorted as strings).

    Null and empty texts have no words and hit nothing; items without words are never found. Rows of equal doc_id, or without
    one, are documents of their own. Of shingles that are equally rare, the one of least hash is the prefix. Texts of any
    length are taken whole; a text's hits are gathered in one row. Empty tables give an empty result or no hits. Columns other
    than doc_id, text and item_id aren't read.
    """
    every, found = occurrences(_prepared(docs), windows_of(benchmark, window), window)
    hits = small(written(contaminated(found), "decontaminate-hits"))
    df = every.join(hits, ["k1", "k2"], "left")
    return df.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", F.expr("CAST(array() AS array<string>)")).alias("item_ids"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs, with all their columns, that have no hit. Otherwise as decontaminate()."""
    prepared = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    _, found = occurrences(prepared.select("doc_id", "text"), windows_of(benchmark, window), window)
    gone = small(written(found.select("k1", "k2").distinct(), "decontaminate-gone"))
    return prepared.select("row", *map(F.expr, KEY)).join(gone, ["k1", "k2"], "left_anti").select("row.*")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
