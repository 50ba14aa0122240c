"""The queries opN_<name>: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm import decontaminate, html_text, jaccard_join, language_id, mixing, outliers, pseudonyms, secrets, token_files, toxicity
from folium.llm.shared import shared_folder, table
from folium.llm.sql import outliers_sql

#: The id that ends a document, and the tokenizer's file.
END_ID, TOKENIZER = 1, "word_bpe_49k.json"
#: The session's setting that has the key of pseudonyms.
PSEUDONYM_KEY = "spark.folium.pseudonyms.key"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def token_ids(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    folder = shared_folder(spark, "token-ids")
    token_files.write_token_files(docs, folder, tokenizer_path(), END_ID)
    return token_files.read_token_files(spark, folder)


def fold(parts: int) -> Column:
    """crc32 of the id as text, modulo parts."""
    return F.crc32(F.col("doc_id").cast("string")) % parts


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify(table(spark, sf_dir, "documents"), usable=fold(4) != 2)
    return found.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2.0, seed=1)


#: Sources' weights by turn, targets where level * weight meets 2 * size, documents in order of their keys.
OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         -ln((('0x' || substr(md5('1:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)
           / CASE WHEN length(text) > 0
                  THEN greatest(0.05, 1.0 - 4 * (length(text) - length(translate(text, '#*$%&|<>', '')))::DOUBLE / length(text))
                  ELSE 0.05 END AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([3.0, 1.0, 2.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w,
             source_size * 2.0::DOUBLE AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
l AS (SELECT *, total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room,
             sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM w),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT max(room / open) FROM l WHERE room / open <= cap / w) * w, cap))::DOUBLE AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
k AS (SELECT d.doc_id, d.size, r.source_size, r.target, r.epochs, r.target - r.epochs * r.source_size AS rest,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, ((epochs + (source_size > 0 AND rest - before >= size / 2.0)::BIGINT) * size)::BIGINT AS taken,
       epochs + (source_size > 0 AND rest - before >= size / 2.0)::BIGINT AS epochs
FROM k"""


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score_texts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), usable=fold(5) != 0)
    return found.select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted")


def op8_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.judge(table(spark, sf_dir, "documents")).drop("d2")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op10_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(table(spark, sf_dir, "documents"), key=spark.conf.get(PSEUDONYM_KEY, "for tests, where the setting is missing"))


#: Every window of every item against every place of its length, and the words under them counted once.
OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT item_id, least(10, len(w)) AS k, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM v),
p AS (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM q) WHERE len(w) >= k),
h AS (SELECT p.r, p.i, p.k, q.item_id FROM p JOIN q ON q.k = p.k AND q.win = array_to_string(p.w[p.i:p.i + p.k - 1], ' ')),
c AS (SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest(range(i, i + k)) AS place FROM h) GROUP BY r),
s AS (SELECT r, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM h) GROUP BY r)
SELECT d.doc_id, coalesce(len(d.w), 0)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(s.n, 0)::BIGINT AS n_items,
       sha256(coalesce(s.ids, '')) AS items_sha256, c.n IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN s USING (r)"""

_LETTER = {c: f"[{c.upper()}{c}]" for c in "abcdefghijklmnopqrstuvwxyz"}
_ASSIGN = "(" + "|".join("".join(_LETTER.get(c, c) for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_TAIL = "(1 / (1 + exp(least(700::DOUBLE, 1.5976::DOUBLE * ({0}) + 0.070566::DOUBLE * pow({0}, 3)))))"

#: Matches and what stands between them give places; characters of runs as rows give the battery.
OP5_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
x AS (SELECT r, 0 AS k, regexp_extract_all(text, '{_ASSIGN}') AS f, string_split_regex(text, '{_ASSIGN}') AS g FROM d
      UNION ALL SELECT r, 1, regexp_extract_all(text, 'AKIA[A-Z0-9]+'), string_split_regex(text, 'AKIA[A-Z0-9]+') FROM d
      UNION ALL SELECT r, 2, regexp_extract_all(text, '[0-9a-f]+'), string_split_regex(text, '[0-9a-f]+') FROM d
      UNION ALL SELECT r, 9, regexp_extract_all(text, '[A-Za-z0-9+/_=-]{{20,}}'), string_split_regex(text, '[A-Za-z0-9+/_=-]{{20,}}') FROM d),
y AS (SELECT r, k, unnest(range(1, len(f) + 1)) AS i, unnest(f) AS f, unnest(g[1:len(f)]) AS g FROM x WHERE len(f) > 0),
z AS (SELECT r, k, f AS v, coalesce(sum(length(f) + length(g)) OVER (PARTITION BY r, k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + length(g) AS s FROM y),
m AS (SELECT r, k, s, s + length(v) AS e, v FROM z),
b AS (SELECT r, k, s, e FROM m WHERE (k = 0 AND length(regexp_extract(v, '{_ASSIGN}', 2)) >= 6) OR (k = 1 AND e - s >= 20) OR (k = 2 AND e - s >= 24)),
o AS (SELECT q.r, q.s AS rs, q.e AS re, q.v, b.s, b.e, greatest(q.s, coalesce(max(b.e) OVER (PARTITION BY q.r, q.s ORDER BY b.s, b.k, b.e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), q.s)) AS begin_
      FROM m q JOIN b ON b.r = q.r AND b.s < q.e AND q.s < b.e WHERE q.k = 9),
p AS (SELECT r, begin_ AS s, substr(v, begin_ - rs + 1, s - begin_) AS v FROM o WHERE s > begin_
      UNION ALL SELECT r, greatest(rs, max(e)), substr(v, greatest(rs, max(e)) - rs + 1, re - greatest(rs, max(e))) FROM o GROUP BY r, rs, re, v HAVING max(e) < re),
u AS (SELECT r, s + length(v) - length(ltrim(v, '+/_=-')) AS s, trim(v, '+/_=-') AS v FROM p),
c AS (SELECT r, s, s + length(v) AS e, rtrim(v, '=') AS v FROM u WHERE length(v) >= 20
      UNION ALL SELECT r, s, e, rtrim(v, '=') FROM m WHERE k = 9 AND NOT EXISTS (SELECT 1 FROM o WHERE o.r = m.r AND o.rs = m.s)),
a AS (SELECT *, length(v) AS n, CASE WHEN regexp_full_match(v, '[0-9]+') THEN '0123456789' WHEN regexp_full_match(v, '[0-9a-f]+') THEN '0123456789abcdef' WHEN regexp_full_match(v, '[0-9A-F]+') THEN '0123456789ABCDEF'
        WHEN regexp_full_match(v, '[a-z]+') THEN '{secrets.LOWER}' WHEN regexp_full_match(v, '[A-Z2-7]+') THEN '{secrets.UPPER}234567' WHEN regexp_full_match(v, '[a-z0-9]+') THEN '{secrets.LOWER}0123456789'
        WHEN regexp_full_match(v, '[A-Z0-9]+') THEN '{secrets.UPPER}0123456789' WHEN regexp_full_match(v, '[A-Za-z0-9_-]+') THEN '{secrets.UPPER}{secrets.LOWER}0123456789-_' ELSE '{secrets.UPPER}{secrets.LOWER}0123456789+/' END AS alphabet
      FROM c WHERE length(v) >= 20),
h AS (SELECT r, s, e, n, length(alphabet)::DOUBLE AS k, alphabet, i, substr(v, i, 1) AS ch FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM a)),
w AS (SELECT *, (instr(alphabet, ch) - 1)::DOUBLE AS x, ([{', '.join(f'{v:.6f}::DOUBLE' for v in secrets.text_log_p())}])[instr('{secrets.ALL}', ch)] AS p FROM h),
l AS (SELECT *, lag(x) OVER (PARTITION BY r, s ORDER BY i) AS x0, avg(x) OVER (PARTITION BY r, s) AS mean FROM w),
t1 AS (SELECT r, s, any_value(e) AS e, any_value(n)::DOUBLE AS n, any_value(k) AS k, -any_value(n) * ln(any_value(k)) - sum(p) AS llr, sum((x >= k / 2)::INT)::DOUBLE AS high,
        coalesce(sum(((x >= k / 2) <> (x0 >= k / 2))::INT), 0)::DOUBLE AS turns, coalesce(sum((x - mean) * (x0 - mean)), 0) AS lagged, sum(pow(x - mean, 2)) AS spread FROM l GROUP BY r, s),
t2 AS (SELECT r, s, sum(pow(n, 2)) AS squares FROM (SELECT r, s, ch, count(*)::DOUBLE AS n FROM h WHERE contains(alphabet, ch) GROUP BY ALL) GROUP BY r, s),
t3 AS (SELECT t1.*, greatest(k / n * coalesce(squares, 0) - n, 0) AS chi, 2 * high * (n - high) / n AS pairs FROM t1 LEFT JOIN t2 USING (r, s)),
t4 AS (SELECT r, s, e, n, llr, (pow(chi / (k - 1), 1.0::DOUBLE / 3) - (1 - 2 / (9 * (k - 1)))) / sqrt(2 / (9 * (k - 1))) AS z1,
        abs(CASE WHEN high = 0 OR high = n THEN 1e3 ELSE (turns - pairs) / sqrt(greatest(1e-9, pairs * (pairs - 1) / (n - 1))) END) AS z2, abs(sqrt(n) * lagged / greatest(1e-9, spread)) AS z3 FROM t3),
t5 AS (SELECT *, -ln(greatest(1e-300, {_TAIL.format('z1')})) - ln(greatest(1e-300, least(1, 2 * {_TAIL.format('z2')}))) - ln(greatest(1e-300, least(1, 2 * {_TAIL.format('z3')}))) AS y FROM t4),
t6 AS (SELECT r, s, e, floor(log2(n))::INT AS cls, floor(2 * greatest(0, least({secrets.LARGEST}, llr - y + ln(1 + y + y * y / 2))))::INT AS half FROM t5),
n AS (SELECT cls, least(half, {secrets.LARGEST}) AS half, count(*) AS n FROM t6 GROUP BY ALL),
q AS (SELECT cls, min(half) AS bar FROM (SELECT cls, half, sum(n) OVER (PARTITION BY cls ORDER BY half DESC) AS above, sum(n) OVER (PARTITION BY cls) AS m FROM n) WHERE half > 0 AND exp(-half / 2.0) * m <= {secrets.FDR} * above GROUP BY cls),
f AS (SELECT r, s, k, e FROM b UNION ALL SELECT r, s, 3, e FROM t6 JOIN q USING (cls) WHERE half >= bar),
g AS (SELECT r, count_if(k = 0) AS n0, count_if(k = 1) AS n1, count_if(k = 2) AS n2, string_agg(['assign', 'access', 'hex', 'random'][k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k, e) FILTER (WHERE k < 3) AS base,
        string_agg(['assign', 'access', 'hex', 'random'][k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k, e) AS spans FROM f GROUP BY r)
SELECT doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)"""

#: All pairs that share a shingle, and who is reached from whom.
OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT id, array_to_string(w[i:i + 3], ' ') AS shingle FROM g),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT a.id AS x, b.id AS y, count(*) AS c FROM s a JOIN s b USING (shingle) WHERE a.id <> b.id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.id = x JOIN n b ON b.id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
r(x, y) AS (SELECT id, id FROM d UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (id) JOIN (SELECT x AS id, min(doc_id) AS component_id FROM r JOIN d ON d.id = y GROUP BY x) c USING (id)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_decontaminate": op2_decontaminate,
    "op3_token_ids": op3_token_ids,
    "op4_mixing": op4_mixing,
    "op5_secrets": op5_secrets,
    "op6_html_text": op6_html_text,
    "op7_toxicity": op7_toxicity,
    "op8_outliers": op8_outliers,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_pseudonyms": op10_pseudonyms,
}
SQL: dict[str, str] = {"op2_decontaminate": OP2_SQL, "op4_mixing": OP4_SQL, "op5_secrets": OP5_SQL, "op8_outliers": outliers_sql(), "op9_jaccard_join": OP9_SQL}
