"""Counts against plain Python; the estimates on planted outliers."""

from __future__ import annotations

import collections
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from folium.llm import outliers
from folium.llm.sql import outliers_sql
from tests.llm.conftest import prose


def counts(text: str | None):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, hit = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7)), set()
    for k in range(len(w) - 7):
        if seen[tuple(w[k : k + 8])] > 1:
            hit |= set(range(k, k + 8))
    return (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w))


def test_counts(spark, documents):
    r = random.Random(2)
    texts = ["".join(r.choice(["a", "bb ", " ", "\n", "\t", "#", "é", "a a a a a a a a a ", "\x85", "|<"]) for _ in range(r.randint(0, 60))) for _ in range(300)]
    texts += [None, "", "\n\n", "a " * 8, "a " * 9, "x\nx\nx\n" * 50, prose(8, 1) + " " + prose(8, 1), prose(20_000, 4) + " " + prose(100, 4), "w " * 5_000]
    got = {r.doc_id: tuple(r)[1:7] for r in outliers.judge(documents(texts)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()}
    assert got == {k: counts(t) for k, t in enumerate(texts)}


def test_moments_are_covariances(spark):
    x = np.random.default_rng(0).integers(-400, 400, (200, 4))
    x[:, 1] += x[:, 0] // 2
    df = spark.createDataFrame([("g", *map(int, r)) for r in x], "g string, x1 long, x2 long, x3 long, x4 long")
    made = outliers.factored(outliers.moments(outliers.sums(df, "g"), 1.3, "g"))
    row = made.first()
    cov = 1.3 * np.cov((x / outliers.UNIT).T, bias=True) + np.diag(np.square(outliers.FLOOR))
    low = np.array([[row[f"l{i}{j}"] if j <= i else 0 for j in range(1, 5)] for i in range(1, 5)])
    assert np.allclose(low @ low.T, cov) and np.isclose(row.det**2, np.linalg.det(cov))
    d = np.array([r.d2 for r in outliers.distances(df, made.drop("det")).collect()])
    c = x / outliers.UNIT - x.mean(0) / outliers.UNIT
    assert np.allclose(np.sort(d), np.sort(np.einsum("ij,jk,ik->i", c, np.linalg.inv(cov), c)))


FLOORS = np.diag(np.square(outliers.FLOOR))


def distance(x, m, c):
    return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)


def plain_mcd(x):
    """Least determinant over the three starts' C-steps, by numpy: (rows used, mean, covariance)."""
    mid = np.median(x, 0)
    scale = np.maximum(1.4826 * np.median(np.abs(x - mid), 0), outliers.FLOOR)
    z = (x - mid) / scale
    length = np.sqrt((z * z).sum(1))[:, None]
    u = np.where(length > 0, np.round(z / np.where(length > 0, length, 1) * outliers.UNIT), 0) / outliers.UNIT
    starts = [(mid, np.diag(scale**2)), (x.mean(0), np.cov(x.T, bias=True) + FLOORS), (mid, 4 * u.T @ u / len(x) * np.outer(scale, scale) + FLOORS)]
    found = []
    for k, (m, c) in enumerate(starts):
        was = np.inf
        while True:
            bins = np.floor(np.log2(distance(x, m, c) + 2.0**-10) * 16)
            cut = np.sort(bins)[min(len(x), -(-(len(x) + 5) // 2)) - 1]
            half = x[bins <= cut]
            m, c = half.mean(0), outliers.CONSISTENT_50 * np.cov(half.T, bias=True) + FLOORS
            det = np.linalg.det(c)
            if not det < was * (1 - 1e-12):
                break
            found.append((det, k, len(half), m, c))
            was = det
    return min(found, key=lambda f: f[:2])[2:]


def test_verdicts_against_plain_numpy(spark, documents):
    r = random.Random(4)
    text = lambda k: " ".join(w + ("#" * r.randint(0, 3) if k % 17 == 0 else "") for w in prose(r.randint(20, 200), k).split()) + "\nsame line of words here" * (r.randint(0, 4) * (k % 5 == 0))
    rows = [(k, text(k), "en" if k % 4 else "fr", "hot" if k % 3 == 0 else f"s{k % 40}") for k in range(700)] + [(900, prose(30, 1), "xx", "rare"), (901, "few", "xx", "other")]
    docs = documents(rows)
    x = {t.doc_id: np.array([t.x1, t.x2, t.x3, t.x4]) / outliers.UNIT for t in outliers.statistics(docs).collect()}
    failed = {i: counts(t)[5] for i, t, _, _ in rows}
    groups = collections.defaultdict(list)
    for i, _, lang, source in rows:
        if not failed[i]:
            groups[lang, source].append(i)
            groups[lang,].append(i)

    def drawn(found):
        out = {}
        for g in groups:
            (n, m, c), (_, lm, lc) = found.get(g, (0, 0, 0)), found[g[:1]]
            out[g] = (m, c) if len(g) == 1 else ((n * m + outliers.SHRINK * lm) / (n + outliers.SHRINK), (n * c + outliers.SHRINK * lc) / (n + outliers.SHRINK))
        return out

    raw = drawn({g: plain_mcd(np.array([x[i] for i in ids])) for g, ids in groups.items()})
    within = {}
    for g, ids in groups.items():
        y = np.array([x[i] for i in ids])
        y = y[distance(y, *raw[g]) <= outliers.CHI_975]
        if len(y):
            within[g] = (len(y), y.mean(0), outliers.CONSISTENT_975 * np.cov(y.T, bias=True) + FLOORS)
    final = drawn(within)
    want = {i: not failed[i] and distance(x[i][None], *final[lang, source])[0] <= outliers.CUT for i, _, lang, source in rows}
    got = {r.doc_id: r.kept for r in outliers.judge(docs).collect()}
    assert got == want and 0 < sum(not v for v in want.values()) < 200

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    sql = {row[0]: row[-1] for row in con.execute(outliers_sql()).fetchall()}
    assert sql == want


def test_planted_outliers(spark, documents):
    rows = [(k, prose(30 + k % 200, k), "en" if k % 3 else None, "a" if k % 2 else None) for k in range(400)]
    rows += [(1000 + k, " ".join(w + "###" for w in prose(60, k).split()), "en", "a") for k in range(12)] + [(2000, None, None, None), (2001, "few words", "xx", "rare"), (2002, prose(100, 1), "xx", "rare"), (5, prose(90, 5), "en", "a")]
    got = outliers.judge(documents(rows))
    kept = {r.doc_id: r.kept for r in got.collect()}
    assert all(kept[k] for k in range(400)) and not any(kept[1000 + k] for k in range(12))
    assert not kept[2000] and not kept[2001] and kept[2002] and got.filter(F.col("doc_id") == 5).count() == 2


@pytest.mark.parametrize("share", [0.34, 0.42])
@pytest.mark.parametrize("alike", [True, False])
def test_copies_of_junk_do_not_pass(spark, documents, share, alike):
    junk = lambda k: " ".join(w + "#" * (1 + (alike or (i + k) % 3 > 0)) for i, w in enumerate(prose(60, 9 if alike else k).split()))
    n = round(400 * share)
    rows = [(k, junk(k) if k < n else prose(30 + k % 200, k), "en", "a") for k in range(400)]
    got = {r.doc_id: (r.base_failed, r.kept) for r in outliers.judge(documents(rows)).collect()}
    assert not any(got[k][0] or got[k][1] for k in range(n)) and all(got[k][1] for k in range(n, 400))


def test_empty(spark, documents):
    assert outliers.judge(documents([]).limit(0)).collect() == []
