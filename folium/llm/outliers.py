"""Quality rules: fixed limits, and robust multivariate outliers by minimum covariance determinant.

Everything is Spark expressions. Each document gives counts, and those a vector of four transformed statistics, kept as
whole numbers of 1/512 so that sums are exact and don't depend on their order. Per language and source, and per language:

* three starts: medians and scaled median absolute deviations; means and covariances of all; covariances of the signs, that
  is of vectors scaled to the length 1 about the medians. No variance is below a floor;
* C-steps: the half of least distance, by a histogram of distances, gives the next mean and covariance, until no
  determinant gets less; of all starts the estimate with the least determinant stays. So junk may be almost half of a group;
* the result is scaled to be consistent for normal data, and reweighted once by the documents within the 97.5 % point;
* a source's estimates are drawn to its language's as if SHRINK documents of it had these: a small source is judged almost as
  its language is, a large one by itself, and no size changes that at once;
* a document is rejected if its squared Mahalanobis distance is above CUT.

Only sums and histograms by group are shuffled.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm.shared import kept, let, rows_of, small, written

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
UNIT, DIMS, SHRINK = 512, 4, 100
#: 50 % (the share of a large group in the C-steps) and 97.5 % points of chi-squared with 4 degrees of freedom.
CHI_50, CHI_975 = 3.3567, 11.143
#: 0.5 / P(chi-squared with 6 degrees of freedom <= CHI_50), and likewise for 97.5 %.
CONSISTENT_50, CONSISTENT_975 = 2.1091, 1.0857
#: Variances are raised by the square of this, so that a statistic which hardly varies rejects nothing on its own.
FLOOR = (0.04, 0.04, 0.06, 0.04)
#: Squared distance beyond which a document is rejected: about one in 10^9 of normal data.
CUT = 47.0


def repeated(words: str, width: int = 8) -> str:
    """SQL for the number of words in windows that occur twice or more. Windows are sorted by hash only if one does."""
    hashes = let("v", f"transform({words}, x -> xxhash64(x))", f"transform(sequence(1, size(v) - {width - 1}), i -> xxhash64(slice(v, i, {width})))")
    neighbours = "flatten(zip_with(slice(s, 1, size(s) - 1), slice(s, 2, size(s) - 1), (a, b) -> IF(a.h = b.h, array(a.i, b.i), CAST(array() AS array<int>))))"
    places = let("s", "sort_array(zip_with(h, sequence(0, size(h) - 1), (x, i) -> named_struct('h', x, 'i', i)))", f"sort_array(array_distinct({neighbours}))")
    covered = f"aggregate({places}, named_struct('upto', 0, 'n', 0L), (a, p) -> named_struct('upto', p + {width}, 'n', a.n + p + {width} - greatest(a.upto, p)), a -> a.n)"
    return f"IF(size({words}) <= {width}, 0L, {let('h', hashes, f'IF(size(array_distinct(h)) = size(h), 0L, {covered})')})"


def statistics(docs: DataFrame) -> DataFrame:
    """docs' doc_id, lang, source, the counts, and x1 to x4.

    A text's windows of 8 words are compared by 64-bit hashes; only texts with a repeated window are sorted.
    """
    df = docs.select("doc_id", "lang", "source", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    df = df.withColumn("w", F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).withColumn("n_words", F.size("w").cast("long"))
    df = df.withColumn("word_chars", F.length(F.translate("text", " \t\n\v\f\r", "")).cast("long"))
    df = df.withColumn("n_symbols", (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long"))
    df = df.withColumn("lines", F.expr(r"filter(split(text, '\n', -1), l -> l RLIKE '[^\\x20\\x09-\\x0D]')"))
    df = df.withColumn("n_lines", F.size("lines").cast("long")).withColumn("n_dup_lines", F.col("n_lines") - F.size(F.array_distinct("lines")))
    df = df.withColumn("n_repeat_words", F.expr(repeated("w")))
    x = (
        "ln((word_chars + 500D) / (n_words + 100D))",
        "asin(sqrt(n_symbols / (word_chars + 20D)))",
        "n_dup_lines / (n_lines + 5D)",
        "n_repeat_words / (n_words + 50D)",
    )
    return df.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *[F.expr(f"CAST(round({e} * {UNIT}) AS bigint)").alias(f"x{i}") for i, e in enumerate(x, 1)])


PAIRS = [(i, j) for i in range(1, DIMS + 1) for j in range(1, i + 1)]
X, M, C = [f"x{i}" for i in range(1, DIMS + 1)], [f"m{i}" for i in range(1, DIMS + 1)], [f"c{i}{j}" for i, j in PAIRS]
SUMS = ["n", *[f"s{i}" for i in range(1, DIMS + 1)], *[f"q{i}{j}" for i, j in PAIRS]]


def sums(rows: DataFrame, *keys: str) -> DataFrame:
    """Per key the number of rows and the sums of their statistics and products, which are exact."""
    parts = ["count(*) AS n", *[f"sum(x{i}) AS s{i}" for i in range(1, DIMS + 1)], *[f"sum(x{i} * x{j}) AS q{i}{j}" for i, j in PAIRS]]
    return rows.groupBy(*keys).agg(*map(F.expr, parts))


def moments(found: DataFrame, scale: float, *keys: str) -> DataFrame:
    """Of sums: n, means m1.., and the covariances c11, c21.. times scale, plus the floors."""
    df = found.selectExpr(*keys, "n", *[f"s{i} / n / {UNIT} AS m{i}" for i in range(1, DIMS + 1)], *[f"q{i}{j}" for i, j in PAIRS])
    return df.selectExpr(*keys, "n", *M, *[f"{scale}D * (q{i}{j} / n / {UNIT**2} - m{i} * m{j}) + {FLOOR[i - 1] ** 2 if i == j else 0.0!r}D AS c{i}{j}" for i, j in PAIRS])


def factored(estimates: DataFrame) -> DataFrame:
    """With the Cholesky factor l11, l21.. of the covariances, and its determinant. Each entry is named once and used by the
    next ones; as columns, Catalyst would write out their formulas within each other."""
    names = [f"l{i}{j}" for i, j in PAIRS]
    det = " * ".join(f"l{i}{i}" for i in range(1, DIMS + 1))
    sql = f"named_struct({', '.join(f"'{n}', {n}" for n in names)}, 'det', {det})"
    for i, j in reversed(PAIRS):  # the diagonal of a row comes last
        rest = f"c{i}{j}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(1, j))
        value = f"sqrt(greatest({rest}, {FLOOR[i - 1] ** 2 / 100!r}D))" if i == j else f"({rest}) / l{j}{j}"
        sql = f"transform(array({value}), l{i}{j} -> {sql})" if (i, j) == PAIRS[0] else let(f"l{i}{j}", value, sql)
    return estimates.select("*", F.expr(f"inline({sql})"))


def distances(rows: DataFrame, estimates: DataFrame, how: str = "left") -> DataFrame:
    """rows with d2, the squared distance by the estimates of their g (and of its starts, if they tell those)."""
    starts = [c for c in ("start", "det") if c in estimates.columns]
    df = rows.join(small(estimates), "g", how)
    for i in range(1, DIMS + 1):
        df = df.selectExpr("*", f"(x{i} / {UNIT}D - m{i}{''.join(f' - l{i}{k} * y{k}' for k in range(1, i))}) / l{i}{i} AS y{i}")
    return df.selectExpr(*rows.columns, *starts, " + ".join(f"y{i} * y{i}" for i in range(1, DIMS + 1)) + " AS d2")


def c_step(rows: DataFrame, now: DataFrame) -> DataFrame:
    """The estimates by the half that is nearest to those of now, where their determinants are less. A half are the rows up to
    the least sixteenth of a power of two of d2 that has (n + DIMS + 1) / 2 of n rows, or all."""
    binned = distances(rows, now, "inner").selectExpr("*", f"floor(log2(d2 + {2.0**-10!r}D) * 16) AS bin")
    found = sums(binned, "g", "start", "det", "bin")
    each = "OVER (PARTITION BY g, start, det"
    found = found.selectExpr("*", f"sum(n) {each} ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS before", f"sum(n) {each}) AS all_")
    half = found.filter(f"2 * before < least(2 * all_, all_ + {DIMS + 1})").groupBy("g", "start", "det").agg(*[F.expr(f"sum({c}) AS {c}") for c in SUMS])
    return factored(moments(half.withColumnRenamed("det", "was"), CONSISTENT_50, "g", "start", "was")).filter("det < was").drop("was")


def converged(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """C-steps for each start of each g until its determinant doesn't get less; all estimates on the way.

    A step's sums are exact and determinants only get less, so none comes twice and the steps end.
    """
    now = written(factored(starts).withColumn("det", F.lit(math.inf)), "outliers-mcd")
    steps = []
    while True:
        now = written(c_step(rows, now), "outliers-mcd")
        if not rows_of(now):
            return reduce(DataFrame.unionByName, steps) if steps else now
        steps.append(now)


def drawn(estimates: DataFrame, pairs: DataFrame) -> DataFrame:
    """estimates with those of pairs (g, lang_g) drawn to their languages' and factored; a pair without one has its language's."""
    own = lambda c: f"(coalesce(n, 0) * coalesce({c}, 0D) + {SHRINK} * {c}_) / (coalesce(n, 0) + {SHRINK}) AS {c}"
    lang = estimates.selectExpr("g AS lang_g", *[f"{c} AS {c}_" for c in (*M, *C)])
    df = pairs.join(estimates, "g", "left").join(lang, "lang_g").selectExpr("g", "n", *map(own, (*M, *C)))
    return factored(df.unionByName(estimates.join(pairs.select("g"), "g", "left_anti").select("g", "n", *M, *C)))


def judge(docs: DataFrame, cut: float = CUT) -> DataFrame:
    """Per row: doc_id, n_words, the four counts, base_failed, kept, d2 (squared distance).

    A null text has no words and fails the base. Null languages and sources are values of their own. Rows of equal
    doc_id, and repeated rows, are judged each by itself, and each counts in the estimates; statistics that tie for the
    nearest half are all in it. Rows that fail the base take no part in the estimates. Texts of any length are taken whole.
    An empty table gives an empty result. Columns other than doc_id, text, lang and source aren't read.
    """
    df = statistics(docs).withColumn("base_failed", F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words"))
    pair, lang = F.to_json(F.struct("source", "lang")), F.to_json(F.struct("lang"))
    rows = kept(df.withColumn("g", pair).withColumn("lang_g", lang).drop("lang", "source"))
    fit = rows.filter("NOT base_failed").select(F.explode(F.array("g", "lang_g")).alias("g"), *X)
    pairs = written(rows.filter("NOT base_failed").select("g", "lang_g").distinct(), "outliers-groups")
    # medians of whole numbers: their counts by value are what is merged
    middle = written(fit.groupBy("g").agg(*[F.percentile(x, 0.5).alias(f"p{x}") for x in X]), "outliers-start")
    apart = fit.join(small(middle), "g")
    spread = written(apart.groupBy("g").agg(*[F.first(f"p{x}").alias(f"p{x}") for x in X], *[F.percentile(F.abs(F.col(x) - F.col(f"p{x}")), 0.5).alias(f"a{x}") for x in X]), "outliers-start")
    scale = {i: f"greatest(1.4826D * ax{i} / {UNIT}, {f!r}D)" for i, f in enumerate(FLOOR, 1)}
    at = [f"px{i} / {UNIT} AS m{i}" for i in range(1, DIMS + 1)]
    first = spread.selectExpr("g", "0 AS start", *at, *[f"{scale[i]} * {scale[i]} AS c{i}{j}" if i == j else f"0D AS c{i}{j}" for i, j in PAIRS])
    second = moments(sums(fit, "g"), 1.0, "g").selectExpr("g", "1 AS start", *M, *C)
    signs = fit.join(small(spread), "g").selectExpr("*", *[f"(x{i} - px{i}) / {UNIT} / {scale[i]} AS z{i}" for i in range(1, DIMS + 1)])
    # signs as whole numbers too, so that their sums are exact
    signs = signs.selectExpr("*", f"sqrt({' + '.join(f'z{i} * z{i}' for i in range(1, DIMS + 1))}) AS len")
    signs = signs.selectExpr("*", *[f"IF(len > 0, CAST(round(z{i} / len * {UNIT}) AS bigint), 0L) AS u{i}" for i in range(1, DIMS + 1)])
    mean = signs.groupBy("g").agg(*map(F.expr, ["count(*) AS k", *[f"first({c}{x}) AS {c}{x}" for x in X for c in "pa"], *[f"sum(u{i} * u{j}) AS u{i}{j}" for i, j in PAIRS]]))
    third = mean.selectExpr("g", "2 AS start", *at, *[f"{DIMS} * u{i}{j} / k / {UNIT**2} * {scale[i]} * {scale[j]} + {FLOOR[i - 1] ** 2 if i == j else 0.0!r}D AS c{i}{j}" for i, j in PAIRS])
    found = converged(fit, first.unionByName(second).unionByName(third))
    best = found.groupBy("g").agg(F.min_by(F.struct("n", *M, *C), F.struct("det", "start")).alias("e")).select("g", "e.*")
    raw = written(drawn(best, pairs), "outliers-mcd")
    within = written(moments(sums(distances(fit, raw).filter(F.col("d2") <= CHI_975), "g"), CONSISTENT_975, "g"), "outliers-mcd")
    df = distances(rows, written(drawn(within, pairs), "outliers-mcd"))
    kept_ = (~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= cut)).alias("kept")
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept_, "d2")
