"""SQL for DuckDB that is made from its parts."""

from __future__ import annotations

from folium.llm import outliers as o

_RANGE = range(1, o.DIMS + 1)
_M, _C = ", ".join(o.M), ", ".join(o.C)
_L = ", ".join(f"l{i}{j}" for i, j in o.PAIRS)


def _factored(source: str) -> str:
    """source with the Cholesky factor of its covariances and the determinant."""
    sql = source
    for i, j in o.PAIRS:
        rest = f"c{i}{j}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(1, j))
        value = f"sqrt(greatest({rest}, {o.FLOOR[i - 1] ** 2 / 100!r}::DOUBLE))" if i == j else f"({rest}) / l{j}{j}"
        sql = f"(SELECT *, {value} AS l{i}{j} FROM {sql})"
    return f"(SELECT *, {' * '.join(f'l{i}{i}' for i in _RANGE)} AS det FROM {sql})"


def _distances(source: str) -> str:
    """source, which has x1.. and an estimate, with d2."""
    sql = source
    for i in _RANGE:
        y = f"x{i} / {o.UNIT}::DOUBLE - m{i}" + "".join(f" - l{i}{k} * y{k}" for k in range(1, i))
        sql = f"(SELECT *, ({y}) / l{i}{i} AS y{i} FROM {sql})"
    return f"(SELECT *, {' + '.join(f'y{i} * y{i}' for i in _RANGE)} AS d2 FROM {sql})"


def _moments(source: str, scale: float, keys: str) -> str:
    """Means and covariances of the rows of source by keys."""
    sums = ", ".join([f"sum(x{i}) / count(*)::DOUBLE / {o.UNIT} AS m{i}" for i in _RANGE] + [f"sum(x{i} * x{j})::DOUBLE AS q{i}{j}" for i, j in o.PAIRS])
    cov = ", ".join(f"{scale}::DOUBLE * (q{i}{j} / n / {o.UNIT**2} - m{i} * m{j}) + {o.FLOOR[i - 1] ** 2 if i == j else 0.0!r}::DOUBLE AS c{i}{j}" for i, j in o.PAIRS)
    return f"(SELECT {keys}, n, {_M}, {cov} FROM (SELECT {keys}, count(*) AS n, {sums} FROM {source} GROUP BY {keys}))"


def _drawn(estimates: str) -> str:
    own = ", ".join(f"(coalesce(e.n, 0) * coalesce(e.{c}, 0) + {o.SHRINK} * f.{c}) / (coalesce(e.n, 0) + {o.SHRINK}) AS {c}" for c in (*o.M, *o.C))
    return _factored(f"(SELECT p.g, {own} FROM pairs p LEFT JOIN {estimates} e ON e.g = p.g JOIN {estimates} f ON f.g = p.lang_g UNION ALL SELECT g, {_M}, {_C} FROM {estimates} WHERE g NOT IN (SELECT g FROM pairs))")


def outliers_sql() -> str:
    """The estimates as a recursion over C-steps."""
    scale = [f"greatest(1.4826::DOUBLE * a{i} / {o.UNIT}, {f!r}::DOUBLE)" for i, f in zip(_RANGE, o.FLOOR, strict=True)]
    x = ("ln((word_chars + 500::DOUBLE) / (n_words + 100::DOUBLE))", "asin(sqrt(n_symbols / (word_chars + 20::DOUBLE)))", "n_dup_lines / (n_lines + 5::DOUBLE)", "n_repeat_words / (n_words + 50::DOUBLE)")
    z = ", ".join(f"(x{i} - p{i}) / {o.UNIT}::DOUBLE / ({s}) AS z{i}" for i, s in zip(_RANGE, scale, strict=True))
    u = ", ".join(f"CASE WHEN len > 0 THEN round(z{i} / len * {o.UNIT})::BIGINT ELSE 0 END AS u{i}" for i in _RANGE)
    at = ", ".join(f"any_value(p{i}) / {o.UNIT}::DOUBLE AS m{i}" for i in _RANGE)
    any_scale = [s.replace(f"a{i}", f"any_value(a{i})") for i, s in zip(_RANGE, scale, strict=True)]
    first = ", ".join(f"any_value({scale[i - 1]}) * any_value({scale[i - 1]}) AS c{i}{j}" if i == j else f"0::DOUBLE AS c{i}{j}" for i, j in o.PAIRS)
    third = ", ".join(f"{o.DIMS} * sum(u{i} * u{j}) / count(*)::DOUBLE / {o.UNIT**2} * ({any_scale[i - 1]}) * ({any_scale[j - 1]}) + {o.FLOOR[i - 1] ** 2 if i == j else 0.0!r}::DOUBLE AS c{i}{j}" for i, j in o.PAIRS)
    binned = f"(SELECT g, start, det, floor(log2(d2 + {2.0**-10!r}::DOUBLE) * 16) AS bin, {', '.join(o.X)} FROM " + _distances("(SELECT fit.*, est.* EXCLUDE (g) FROM fit JOIN est ON est.g = fit.g)") + ")"
    counted = f"(SELECT *, count(*) OVER (PARTITION BY g, start, det ORDER BY bin) - count(*) OVER (PARTITION BY g, start, det, bin) AS before, count(*) OVER (PARTITION BY g, start, det) AS every FROM {binned})"
    step = _factored(_moments(f"(SELECT *, det AS was FROM {counted} WHERE 2 * before < least(2 * every, every + {o.DIMS + 1}))", o.CONSISTENT_50, "g, start, was"))
    return rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
v AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS win FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
t AS (SELECT r, i FROM v QUALIFY count(*) OVER (PARTITION BY r, win) > 1),
k AS (SELECT r, count(DISTINCT place) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 8)) AS place FROM t) GROUP BY r),
s AS (SELECT r, doc_id, to_json({{'s': source, 'l': lang}})::VARCHAR AS g, to_json({{'l': lang}})::VARCHAR AS lang_g, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN k USING (r)),
rows AS MATERIALIZED (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {', '.join(f'round({e} * {o.UNIT})::BIGINT AS x{i}' for i, e in zip(_RANGE, x, strict=True))} FROM s),
fit AS MATERIALIZED (SELECT g, {', '.join(o.X)} FROM rows WHERE NOT base_failed UNION ALL SELECT lang_g, {', '.join(o.X)} FROM rows WHERE NOT base_failed),
pairs AS (SELECT DISTINCT g, lang_g FROM rows WHERE NOT base_failed),
middle AS (SELECT g, {', '.join(f'quantile_cont(x{i}, 0.5) AS p{i}' for i in _RANGE)} FROM fit GROUP BY g),
spread AS (SELECT g, {', '.join(f'any_value(p{i}) AS p{i}, quantile_cont(abs(x{i} - p{i}), 0.5) AS a{i}' for i in _RANGE)} FROM fit JOIN middle USING (g) GROUP BY g),
signs AS (SELECT *, {u} FROM (SELECT *, sqrt({' + '.join(f'z{i} * z{i}' for i in _RANGE)}) AS len FROM (SELECT *, {z} FROM fit JOIN spread USING (g)))),
starts AS (SELECT g, 0 AS start, {at}, {first} FROM spread GROUP BY g UNION ALL SELECT g, 1, {_M}, {_C} FROM {_moments('fit', 1.0, 'g')} UNION ALL SELECT g, 2, {at}, {third} FROM signs GROUP BY g),
est AS (SELECT g, start, 0::BIGINT AS n, {_M}, {_C}, {_L}, 'infinity'::DOUBLE AS det FROM {_factored('starts')}
        UNION ALL SELECT g, start, n, {_M}, {_C}, {_L}, det FROM {step} WHERE det < was),
best AS (SELECT g, n, {_M}, {_C} FROM est WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY g ORDER BY det, start) = 1),
raw AS MATERIALIZED (SELECT * FROM {_drawn('best')}),
within AS MATERIALIZED (SELECT * FROM {_moments('(SELECT * FROM ' + _distances('(SELECT fit.*, raw.* EXCLUDE (g) FROM fit JOIN raw ON raw.g = fit.g)') + f' WHERE d2 <= {o.CHI_975})', o.CONSISTENT_975, 'g')}),
final AS MATERIALIZED (SELECT * FROM {_drawn('within')})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(d2, 0) <= {o.CUT} AS kept
FROM {_distances('(SELECT rows.*, final.* EXCLUDE (g) FROM rows LEFT JOIN final ON final.g = rows.g)')}"""
