"""Secret scans: fixed patterns, and a battery of randomness tests with control of false discoveries.

Everything is Spark expressions. A run of at least 20 characters that encodings use is tried:

* its encoding is inferred from the characters it has, which gives the alphabet of k symbols;
* chi-squared of the symbols' counts against uniform, a runs test about the alphabet's middle and the lag-1 serial
  correlation each give a p-value under randomness; Fisher's method makes one of the three, P;
* against the opposite hypothesis, text by letter frequencies, exp(L) has mean 1, where L is the log likelihood ratio of
  random over text; P is at most 1, so P exp(L) has at most that mean, and 1 / (P exp(L)) is a p-value by Markov's
  inequality. So a run is only found if it is far likelier to be random than text, and the less so the more the battery
  speaks against it; L grows with length, so short runs need more;
* Benjamini-Hochberg at rate FDR is applied to those combined p-values of all runs of all documents, within classes of
  length by powers of two. Its thresholds come from counts by (class, half unit of the p-value's logarithm): a table whose
  size is bounded, since beyond 700 the p-value is 0 in double precision and all such runs are alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.llm.shared import kept, let

FDR, LARGEST = 0.01, 1400
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"
RUN = "[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
#: Per cent of the letters a to z in text, after published counts of English.
LETTERS = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)
LOWER, UPPER, DIGITS, REST = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/_=-"
ALL = LOWER + UPPER + DIGITS + REST


def text_log_p() -> list[float]:
    """Log probability of each character of ALL in ordinary runs: 84 % lower case, 6 % each of upper case and digits, the rest signs."""
    share = sum(LETTERS)
    p = [0.84 * x / share for x in LETTERS] + [0.06 * x / share for x in LETTERS] + [0.06 / 10] * 10 + [0.04 / 5] * 5
    return [math.log(x) for x in p]


def spans(text: str, pattern: str) -> str:
    """SQL for array<struct<s, e, v>> of the leftmost matches of pattern that don't overlap; code points, e exclusive.

    The pieces that split() leaves between the matches give their places, summed up in blocks of about the square root of
    their number: appending to one long array would copy it for each.
    """
    p = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    pairs = f"filter(zip_with(regexp_extract_all({text}, {p}, 0), split({text}, {p}, -1), (f, g) -> named_struct('f', f, 'g', length(g))), x -> x.f IS NOT NULL)"
    blocks = "transform(sequence(0, CAST((size(ps) - 1) DIV width AS int)), b -> slice(ps, b * width + 1, width))"
    sums = "transform(bs, b -> aggregate(b, 0L, (n, x) -> n + x.g + length(x.f)))"
    starts = f"aggregate({sums}, named_struct('at', 0L, 'out', CAST(array() AS array<bigint>)), (a, n) -> named_struct('at', a.at + n, 'out', concat(a.out, array(a.at))), a -> a.out)"
    inside = """aggregate(b, named_struct('at', st, 'out', CAST(array() AS array<struct<s: bigint, e: bigint, v: string>>)),
        (a, x) -> named_struct('at', a.at + x.g + length(x.f), 'out', concat(a.out, array(named_struct('s', a.at + x.g, 'e', a.at + x.g + length(x.f), 'v', x.f)))), a -> a.out)"""
    placed = let("width", "CAST(ceil(sqrt(size(ps))) AS int)", let("bs", blocks, f"flatten(zip_with(bs, {starts}, (b, st) -> {inside}))"))
    return let("ps", pairs, f"IF(size(ps) = 0, {NONE}, {placed})")


NONE = "CAST(array() AS array<struct<s: bigint, e: bigint, v: string>>)"


def rest(run: str, base: str) -> str:
    """SQL for array<struct<s, e, v>> of what the spans of base leave of run, without signs at the ends."""
    piece = lambda s, e: f"array(named_struct('s', {s}, 'v', substring({run}.v, CAST({s} - {run}.s + 1 AS int), CAST({e} - {s} AS int))))"
    cut = f"""aggregate(filter(sort_array({base}), b -> b.s < {run}.e AND {run}.s < b.e),
        named_struct('at', {run}.s, 'out', CAST(array() AS array<struct<s: bigint, v: string>>)),
        (a, b) -> named_struct('at', greatest(a.at, b.e), 'out', IF(b.s > a.at, concat(a.out, {piece('a.at', 'b.s')}), a.out)),
        a -> IF(a.at < {run}.e, concat(a.out, {piece('a.at', f'{run}.e')}), a.out))"""
    bare = f"transform({cut}, p -> named_struct('s', p.s + length(p.v) - length(ltrim('{REST}', p.v)), 'v', trim(BOTH '{REST}' FROM p.v)))"
    return f"transform(filter({bare}, p -> length(p.v) >= 20), p -> named_struct('s', p.s, 'e', p.s + length(p.v), 'v', p.v))"


def tested(runs: str) -> list[tuple[str, str]]:
    """Columns that turn array<struct<s, e, v>> to candidates array<struct<s, e, cls, half>>, step by step."""
    log_p = "array(" + ", ".join(f"{x:.6f}D" for x in text_log_p()) + ")"
    alphabet = f"""CASE WHEN rtrim('=', c.v) RLIKE '^[0-9]+$' THEN '{DIGITS}' WHEN rtrim('=', c.v) RLIKE '^[0-9a-f]+$' THEN '{DIGITS}abcdef'
        WHEN rtrim('=', c.v) RLIKE '^[0-9A-F]+$' THEN '{DIGITS}ABCDEF' WHEN rtrim('=', c.v) RLIKE '^[a-z]+$' THEN '{LOWER}'
        WHEN rtrim('=', c.v) RLIKE '^[A-Z2-7]+$' THEN '{UPPER}234567'
        WHEN rtrim('=', c.v) RLIKE '^[a-z0-9]+$' THEN '{LOWER}{DIGITS}' WHEN rtrim('=', c.v) RLIKE '^[A-Z0-9]+$' THEN '{UPPER}{DIGITS}'
        WHEN rtrim('=', c.v) RLIKE '^[A-Za-z0-9_-]+$' THEN '{UPPER}{LOWER}{DIGITS}-_' ELSE '{UPPER}{LOWER}{DIGITS}+/' END"""
    z = lambda p: f"(1 / (1 + exp(least(700D, 1.5976D * ({p}) + 0.070566D * pow({p}, 3)))))"  # noqa: E731  upper tail of the normal
    both = lambda p: f"least(1D, 2 * {z(f'abs({p})')})"
    return [
        ("c1", f"transform({runs}, c -> named_struct('s', c.s, 'e', c.e, 'v', rtrim('=', c.v), 'a', {alphabet}))"),
        ("c2", """filter(transform(c1, c -> named_struct('s', c.s, 'e', c.e, 'n', CAST(length(c.v) AS double), 'k', CAST(length(c.a) AS double),
            'x', transform(array_remove(split(c.v, ''), ''), h -> CAST(instr(c.a, h) - 1 AS double)),
            'squares', aggregate(transform(array_remove(split(c.a, ''), ''), h -> pow(length(c.v) - length(replace(c.v, h, '')), 2)), 0D, (t, y) -> t + y),
            'text', aggregate(transform(array_remove(split(c.v, ''), ''), h -> element_at(""" + log_p + f""", instr('{ALL}', h))), 0D, (t, y) -> t + y))), c -> c.n >= 20)"""),
        ("c3", """transform(c2, c -> named_struct('s', c.s, 'e', c.e, 'n', c.n, 'k', c.k, 'llr', - c.n * ln(c.k) - c.text,
            'chi', c.k / c.n * c.squares - c.n, 'mean', aggregate(c.x, 0D, (t, y) -> t + y) / c.n, 'x', c.x,
            'high', CAST(size(filter(c.x, y -> y >= c.k / 2)) AS double),
            'turns', CAST(size(filter(zip_with(slice(c.x, 2, size(c.x)), slice(c.x, 1, size(c.x) - 1), (y, w) -> (y >= c.k / 2) <> (w >= c.k / 2)), t -> t)) AS double)))"""),
        ("c4", """transform(c3, c -> named_struct('s', c.s, 'e', c.e, 'n', c.n, 'llr', c.llr,
            'z1', (pow(greatest(c.chi, 0D) / (c.k - 1), 1D / 3) - (1 - 2 / (9 * (c.k - 1)))) / sqrt(2 / (9 * (c.k - 1))),
            'z2', IF(c.high = 0 OR c.high = c.n, 1e3D, (c.turns - 2 * c.high * (c.n - c.high) / c.n)
                 / sqrt(greatest(1e-9D, (2 * c.high * (c.n - c.high) / c.n) * (2 * c.high * (c.n - c.high) / c.n - 1) / (c.n - 1)))),
            'z3', sqrt(c.n) * aggregate(zip_with(slice(c.x, 2, size(c.x)), slice(c.x, 1, size(c.x) - 1), (y, w) -> (y - c.mean) * (w - c.mean)), 0D, (t, y) -> t + y)
                 / greatest(1e-9D, aggregate(c.x, 0D, (t, y) -> t + pow(y - c.mean, 2)))))"""),
        ("c5", f"""transform(c4, c -> named_struct('s', c.s, 'e', c.e, 'n', c.n, 'llr', c.llr, 'y', -ln(greatest(1e-300D, {z('c.z1')})) - ln(greatest(1e-300D, {both('c.z2')})) - ln(greatest(1e-300D, {both('c.z3')}))))"""),
        ("candidates", f"""transform(c5, c -> named_struct('s', c.s, 'e', c.e, 'cls', CAST(floor(log2(c.n)) AS int),
            'half', CAST(floor(2 * greatest(0D, least({LARGEST}D, c.llr - c.y + ln(1 + c.y + c.y * c.y / 2)))) AS int)))"""),
    ]


def thresholds(candidates: DataFrame, fdr: float = FDR) -> dict[int, int]:
    """Per class of length the least half unit of the combined p-value's logarithm that Benjamini-Hochberg lets pass; at most
    some 30 classes."""
    counts = candidates.select(F.explode("candidates").alias("c")).groupBy("c.cls", F.least(F.col("c.half"), F.lit(LARGEST)).alias("half")).count()
    found: dict[int, int] = {}
    by: dict[int, dict[int, int]] = {}
    for cls, half, n in counts.collect():  # at most 30 x 1400 counts
        by.setdefault(cls, {})[half] = n
    for cls, halves in by.items():
        m, above = sum(halves.values()), 0
        for half in sorted(halves, reverse=True):
            above += halves[half]
            if half and math.exp(-half / 2) * m <= fdr * above:
                found[cls] = half
    return found


def scan(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """Per row: doc_id, found: array<struct<s, k, e>> of all spans by start, then kind (k is its place in KINDS).

    Null texts are empty and have no spans. Rows of equal doc_id, and repeated rows, are scanned each by itself, and each
    counts in the control of discoveries. Spans of fixed patterns are cut out of runs, and what is left of a run is tested
    without the signs at its ends. Runs whose p-values fall in the same half unit pass or fail together. Texts and runs of
    any length are taken whole. An empty table gives an empty result; columns other than doc_id and text aren't read.
    """
    df = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # runs of 20 characters have in them whatever access and hex find, so texts without one need no other pass
    df = df.withColumn("runs", F.expr(f"IF(text RLIKE '{RUN}', {spans('text', RUN)}, {NONE})"))
    assign = f"""filter({spans('text', ASSIGN)}, c -> length(regexp_extract(c.v, '{ASSIGN.replace(chr(92), chr(92) * 2).replace("'", chr(92) + "'")}', 2)) >= 6)"""
    df = df.withColumn("c_assign", F.expr(f"IF(instr(text, '=') > 0 OR instr(text, ':') > 0, {assign}, {NONE})"))
    for kind, pattern in (("access", ACCESS), ("hex", HEX)):
        df = df.withColumn(f"c_{kind}", F.expr(f"IF(size(runs) > 0, {spans('text', pattern)}, {NONE})"))
    base = [f"transform(c_{kind}, c -> named_struct('s', c.s, 'k', {n}, 'e', c.e))" for n, kind in enumerate(KINDS[:3])]
    df = df.withColumn("base", F.expr(f"concat({', '.join(base)})"))
    free = f"flatten(transform(runs, c -> IF(exists(base, b -> b.s < c.e AND c.s < b.e), {rest('c', 'base')}, array(c))))"
    for name, sql in tested(free):
        df = df.withColumn(name, F.expr(sql))
    df = kept(df.select("doc_id", "base", "candidates"))
    passing = thresholds(df, fdr)
    least: Column = F.create_map(*[F.lit(x) for kv in passing.items() for x in kv]) if passing else F.lit(None).cast("map<int,int>")
    random = F.transform(F.filter("candidates", lambda c: c["half"] >= F.element_at(least, c["cls"])), lambda c: F.struct(c["s"].alias("s"), F.lit(3).alias("k"), c["e"].alias("e")))
    return df.select("doc_id", F.sort_array(F.concat("base", random)).alias("found"))


def digest(found: DataFrame) -> DataFrame:
    """Counts and joined spans of what scan() returns."""
    kinds = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    joined = lambda a: f"array_join(transform({a}, c -> concat_ws(':', element_at({kinds}, c.k + 1), c.s, c.e)), ',')"
    count = lambda k: F.expr(f"CAST(size(filter(found, c -> c.k = {k})) AS bigint)")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.expr(f"sha2({joined('filter(found, c -> c.k < 3)')}, 256)").alias("base_sha256"), F.expr(joined("found")).alias("spans"),
    )
