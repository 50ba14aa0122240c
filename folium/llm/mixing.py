"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key, -ln(u) / quality, with u from a hash of the seed and its id: the documents
of least keys are a sample without replacement in which better documents are likelier. A source's target is met
by as many complete epochs of its documents as fit, then by its documents in key order as far as the rest reaches.
The prefix sum that finds that place is taken over coarse slices of the key's range, over the fine slices in the coarse
one that holds the place, and over single documents only in the fine one, so that no source is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.llm.shared import kept, small, written

#: Sizes count these runs.
WORD = r"[^\x20\x09-\x0D]+"
#: Slices of the key's range per source, and how many of them make a coarse one.
SLICES, FINE = 16_384, 128
SYMBOLS = "#*$%&|<>"


def uniform(seed: int) -> Column:
    """From (0, 1), by seed, document id and text, so that only identical rows share it; DuckDB gives the same."""
    head = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text").cast("string"), F.lit("")))), 1, 12)
    return (F.conv(head, 16, 10).cast("double") + 0.5) / float(2**48)


def quality(text: Column) -> Column:
    """A document's weight, from 0.05 to 1: less the more of its characters are symbols."""
    n = F.length(text)
    symbols = n - F.length(F.translate(text, SYMBOLS, ""))
    return F.when(n > 0, F.greatest(F.lit(0.05), F.lit(1.0) - 4 * symbols / n)).otherwise(F.lit(0.05))


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """(source, source_size) -> with target. Sources by code point, null last, take the weights in turn.

    The targets add up to share x all sizes. One that would exceed most x its source's size stops there and the rest is
    shared by weight again; that ends where target = min(most x size, level x weight), and the level is found by
    prefix sums over the sources in order of size / weight. The windows are over one row a source.
    """
    every = Window.partitionBy()
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (turn % len(weights) + 1).cast("int")).cast("double")
    df = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("all", F.lit(float(share)) * F.sum("source_size").over(every))
    upto = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("left", F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("open", F.sum("w").over(upto.rowsBetween(0, Window.unboundedFollowing)))
    df = df.withColumn("level", F.when(F.col("left") / F.col("open") <= F.col("cap") / F.col("w"), F.col("left") / F.col("open")))
    df = df.withColumn("level", F.max("level").over(every))
    return df.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def cut_part(parts: DataFrame, rests: DataFrame, of: DataFrame) -> DataFrame:
    """(s, rest, part, before): of the parts (source, part, n) of each source's range, after `start` words, the one where the
    sum passes the source's rest. of: the written table of rests. At most some hundred rows a source are summed up."""
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    df = parts.withColumn("sum", F.coalesce(F.sum("n").over(before), F.lit(0))).join(small(rests, of=of), F.col("source").eqNullSafe(F.col("s")))
    df = df.withColumn("before", F.col("start") + F.col("sum")).filter((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("n")))
    return df.select("s", "rest", "part", "before")


def keyed(docs: DataFrame, seed: int, *more: Column) -> DataFrame:
    """doc_id, source, size, key and slice of each row, and more columns."""
    text = F.col("text").cast("string")
    exponential = -F.log(uniform(seed)) / quality(text)
    base = docs.select("doc_id", "source", F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), exponential.alias("key"), *more)
    return base.withColumn("slice", F.floor(F.col("key") / (1 + F.col("key")) * SLICES))


def source_cuts(base: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """Per source (t): source_size, target, full (its complete epochs), rest, and the slice where the rest ends (cut) with the
    words before it."""
    coarse = written(base.groupBy("source", F.floor(F.col("slice") / FINE).alias("part")).agg(F.sum("size").alias("n")), "mix-slices")
    targets = source_targets(coarse.groupBy("source").agg(F.sum("n").alias("source_size")), weights, share, most)
    targets = targets.withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    targets = written(targets.withColumn("rest", F.col("target") - F.col("full") * F.col("source_size")), "mix-targets")
    start = targets.select(F.col("source").alias("s"), "rest", F.lit(0).cast("long").alias("start"))
    part = written(cut_part(coarse, start, targets), "mix-cuts")  # first among the coarse slices, then among those within
    inside = base.join(small(part.select("s", F.col("part").alias("coarse")), of=part), F.col("source").eqNullSafe(F.col("s")) & (F.floor(F.col("slice") / FINE) == F.col("coarse")))
    fine = inside.groupBy("source", F.col("slice").alias("part")).agg(F.sum("size").alias("n"))
    cuts = cut_part(fine, part.select("s", "rest", F.col("before").alias("start")), part).select("s", F.col("part").alias("cut"), F.col("before").alias("cut_before"))
    return written(targets.withColumnRenamed("source", "t").join(cuts, F.col("t").eqNullSafe(F.col("s")), "left").drop("s"), "mix-cuts")


def with_epochs(base: DataFrame, cuts: DataFrame) -> DataFrame:
    """base with its sources' values and epochs, how often each row is taken. Rows beside the cut slice are decided alone,
    those in it by a prefix sum."""
    df = base.join(small(cuts), F.col("source").eqNullSafe(F.col("t")))
    in_cut = F.col("slice") == F.col("cut")
    key = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = df.filter(in_cut).withColumn("sum", F.col("cut_before") + F.coalesce(F.sum("size").over(key), F.lit(0)))
    edge = edge.withColumn("extra", (F.col("rest") - F.col("sum") >= F.col("size") / 2).cast("long"))
    plain = df.filter(F.coalesce(~in_cut, F.lit(True))).withColumn("sum", F.lit(0).cast("long"))
    plain = plain.withColumn("extra", F.coalesce((F.col("slice") < F.col("cut")).cast("long"), F.lit(0).cast("long")))
    return plain.unionByName(edge).withColumn("epochs", F.col("full") + F.col("extra"))


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 1) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken, epochs.

    Null texts and texts without words have size 0 and are taken 0 words. A null source is a source. Rows of equal
    doc_id, or without one, are documents of their own; rows that are identical share a key, and their order among
    themselves doesn't matter. Weights are taken by the sources' order by code point. The document at the end of a source's rest
    is taken if that brings the source nearer to its target, so one very long document may miss it by half its size.
    An empty table gives an empty result. Columns other than doc_id, text and source are not read.
    """
    base = kept(keyed(docs, seed))
    both = with_epochs(base, source_cuts(base, weights, share, most))
    return both.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size")).cast("long").alias("taken"), "epochs")


def repeated(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 1) -> DataFrame:
    """The rows of docs, with all their columns, each as often as mix() takes it. Rows aren't shuffled, but for those in the slices
    where sources' rests end: the others are decided where they are read."""
    cuts = source_cuts(kept(keyed(docs, seed)), weights, share, most)
    df = with_epochs(keyed(docs, seed, F.struct(*docs.columns).alias("row")), cuts).filter("epochs > 0")
    return df.select("row", F.explode(F.expr("sequence(1, CAST(epochs AS int))"))).select("row.*")
