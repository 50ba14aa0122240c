"""Forward-backward against enumeration; held-out accuracy on test data; odd texts."""

from __future__ import annotations

import itertools
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from folium.llm import language_id as lid
from folium.llm.queries import fold, op1_language_id
from folium.llm.wordbytes import NO_LETTER, Words
from tests.llm.conftest import prose

DATA = "/root/testdata/sf0.01"


def test_forward_backward():
    rng = np.random.default_rng(0)
    first, scores, moves = np.array([0, 3, 3, 4, 8]), rng.normal(size=(8, 3)), rng.normal(size=(3, 3))
    got = lid.forward_backward(scores, first, moves)
    for a, b in itertools.pairwise(first):
        want = np.zeros((b - a, 3))
        for path in itertools.product(range(3), repeat=int(b - a)):
            w = np.exp(sum(scores[a + t, y] for t, y in enumerate(path)) + sum(moves[x, y] for x, y in itertools.pairwise(path)))
            for t, y in enumerate(path):
                want[t, y] += w
        if b > a:
            assert np.allclose(got[a:b], want / want.sum(1, keepdims=True))


def test_features_do_not_depend_on_place():
    one, many = Words(["étage"], NO_LETTER), Words(["x y", "zz étage étage"], NO_LETTER)
    a, starts = lid.word_features(one, np.array([0]))
    b, other = lid.word_features(many, np.array([3, 2, 4]))
    assert a.tolist() == b[other[0] : other[1]].tolist() == b[other[2] : other[3]].tolist() and starts[1] == len(a)


EN, FR = "the thing that they think with the other then", "les choses que nous avons avec une autre dans"


def test_code_switching():
    model = lid.train([EN] * 30 + [FR] * 30, ["en"] * 30 + ["fr"] * 30)
    words = Words([EN + " " + FR], NO_LETTER)
    marginal = lid.forward_backward(model.emissions(*lid.word_features(words, np.arange(len(words.start)))), words.first, model.moves)
    half = len(EN.split())
    assert marginal[: half - 1, 0].min() > 0.5 and marginal[half + 1 :, 1].min() > 0.5
    assert lid.label(model, [EN, FR, "", "123 !?", "٣", "²"])[0] == ["en", "fr", "und", "und", "und", "und"]


def test_odd_rows(spark, documents):
    rows = [(k, EN if k % 2 else FR, "en" if k % 2 else "fr", "s") for k in range(60)]
    rows += [(100, None, "en", "s"), (101, "", None, "s"), (102, "12 34", "en", None), (103, EN * 2_000, None, None), (None, EN, None, None), (1, EN, "en", "s")]
    docs = documents(rows)
    got = {(r.doc_id, r.lang_pred) for r in lid.identify(docs, F.lit(True)).collect()}
    assert {(100, "und"), (101, "und"), (102, "und"), (103, "en"), (None, "en"), (1, "en"), (2, "fr")} <= got
    kept = lid.accepted(docs, F.lit(True))
    assert kept.schema == docs.schema and kept.count() == 63
    assert {r.lang_pred for r in lid.identify(docs, F.lit(False)).collect()} == {"und"}
    assert {r.lang_pred for r in lid.identify(docs, F.col("lang") == "en").collect()} == {"en", "und"}
    assert lid.identify(docs.limit(0), F.lit(True)).collect() == []


def test_more_languages_than_64(spark, documents):
    rows = [(100 * j + i, prose(60, 1000 + j, 40), f"l{j:02}", "s") for j in range(70) for i in range(3)]
    model = lid.fitted(documents(rows), F.lit(True))
    assert model.languages == [f"l{j:02}" for j in range(70)]
    assert sum(a == b for a, b in zip(lid.label(model, [r[1] for r in rows[::3]])[0], model.languages, strict=True)) >= 68


def test_words_are_bounded_by_language(monkeypatch):
    monkeypatch.setattr(lid, "WORDS", 200)
    model = lid.train([EN] * 2_000 + [FR] * 20, ["en"] * 2_000 + ["fr"] * 20)
    assert lid.label(model, [EN, FR])[0] == ["en", "fr"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = op1_language_id(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out AND lang IS NOT NULL")
    assert got.filter("lang_pred = lang").count() >= 0.97 * got.count()
    assert docs.filter(fold(4) == 2).count() == got.count()
