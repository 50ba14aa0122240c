"""The pipeline against plain versions of its stages."""

from __future__ import annotations

import os
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folium.llm import language_id
from folium.llm.queries import fold
from tests.llm.conftest import prose
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_jaccard_join import brute as components
from tests.llm.test_token_files import expected


DATA = "/root/testdata/sf0.01"


def test_run(spark, documents, tmp_path):
    rows = [(k, prose(40 + k % 50, k), "en" if k % 3 else "fr", f"s{k % 4}") for k in range(150)]
    rows += [(200 + k, rows[k][1] + (" more" if k % 2 else ""), "en", "s1") for k in range(20)] + [(300, "1 2 3", "en", "s0"), (301, None, None, None), (302, prose(12, 7), "en", "s2")]
    items = [(1, prose(90, 5)[:200]), (2, prose(12, 7))]
    documents(rows, extra=False).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stages, kept = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        kept = stages[name] = stage(spark, kept, str(tmp_path)).persist()
    known = {r.doc_id for r in language_id.identify(docs, fold(4) != 2).filter(f"score >= {corpus_pipeline.LEAST} AND lang_pred <> 'und'").collect()}
    text = {r[0]: r[1] for r in rows}
    assert {r.doc_id for r in stages["language_id"].collect()} == known and not known & {300, 301}
    first = {i for i, _, c in components([(i, text[i]) for i in known]) if i == c}
    assert {r.doc_id for r in stages["jaccard_join"].collect()} == first and len(first) < len(known)
    clean = {r[0] for r in contaminated([(i, text[i]) for i in first], items) if not r[5]}
    assert {r.doc_id for r in stages["decontaminate"].collect()} == clean and clean < first
    assert all(s.columns == docs.columns for name, s in stages.items() if name != "token_ids")
    mixed = [(r.doc_id, r.text) for r in stages["mixing"].collect()]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    assert {i for i, _ in mixed} <= clean and all(mixed.count(m) <= 2 for m in mixed)
    assert abs(sum(size(t) for _, t in mixed) - 1.5 * sum(size(text[i]) for i in clean)) < 4 * 90
    want = sorted(expected(mixed), key=lambda r: r[1])
    assert sorted(map(tuple, kept.collect()), key=lambda r: r[1]) == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()), key=lambda r: r[1]) == want


def test_stages_on_odd_tables(spark, documents, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    odd = [(None, None, None, None), (1, "", None, None), (2, prose(30, 2), None, None), (3, prose(30, 2), "en", None), (4, "12 34", "en", "s"), (2, prose(30, 2), None, None), (5, prose(30_000, 1), "en", "s"), (None, prose(30, 2), None, "s"), (6, prose(25, 9), "en", "s"), (6, prose(25, 10), "en", "s")]
    clashing = documents(odd).selectExpr("*", "1 AS id", "2 AS epochs", "'x' AS lang_pred", "3 AS component_id", "4 AS n_hit", "5 AS copy", "true AS row")
    for docs in (clashing, clashing.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == clashing.columns, name
        assert docs.count() >= 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, clashing, str(tmp_path)).count() > 0, name


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_language_stage_rejects(spark):
    """Texts that switch between two or three of the data's languages, made-up words of none and texts without letters."""
    docs, r = spark.read.parquet(f"{DATA}/documents.parquet"), random.Random(1)
    by = {x: [row.text.split() for row in docs.filter(F.col("lang") == x).filter("length(text) > 600").orderBy("doc_id").limit(30).collect()] for x in ("en", "fr", "de", "es")}
    switching = [" ".join(w for k in range(0, 64, 8) for w in a[k : k + 8] + b[k : k + 8]) for a, b in [*zip(by["en"], by["es"], strict=False), *zip(by["de"], by["fr"], strict=False)]]
    switching += [" ".join(a[:50] + b[:50] + c[:50]) for a, b, c in zip(by["en"], by["fr"], by["de"], strict=False)]
    none = [" ".join("".join(r.choice(letters) for _ in range(r.randint(3, 9))) for _ in range(60)) for letters in ("qwxzkjvbpmgcdhylf", "αβγδεζηθικλμνξο") for _ in range(20)] + [None, "", "12 34 !!"]
    rows = spark.createDataFrame([(10**6 + k, t, None, "s", None) for k, t in enumerate(switching + none)], docs.schema)
    got = [row.doc_id for row in corpus_pipeline.language(spark, docs.unionByName(rows), DATA).select("doc_id").collect()]
    assert sum(i < 10**6 for i in got) >= 0.995 * docs.count()
    left = {i - 10**6 for i in got if i >= 10**6}
    assert not any(k >= len(switching) for k in left) and len(left) <= 0.2 * len(switching)


def test_every_row_is_a_document(spark, documents, tmp_path):
    spark.createDataFrame([(1, prose(12, 77))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, prose(30, 1)), (None, prose(30, 1)), (None, prose(30, 2)), (7, prose(30, 2)), (7, prose(30, 3)), (8, prose(30, 3)), (9, prose(12, 77)), (9, prose(30, 4)), (None, prose(9, 50) + " " + prose(12, 77))]
    docs = documents([(i, t, "en", "s") for i, t in rows])
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["jaccard_join"](spark, docs, str(tmp_path))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([rows[0], rows[3], rows[4], rows[6], rows[7], rows[8]], key=repr)
    clean = stages["decontaminate"](spark, kept, str(tmp_path))
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=repr) == sorted([rows[0], rows[3], rows[4], rows[7]], key=repr)
    assert {(r.doc_id, r.text) for r in stages["mixing"](spark, clean, str(tmp_path)).collect()} <= {(r.doc_id, r.text) for r in clean.collect()}
