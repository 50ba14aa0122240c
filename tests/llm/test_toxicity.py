"""The composed machine against running its parts in turn; held-out accuracy; odd texts."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folium.llm import toxicity as tox
from folium.llm.queries import op7_toxicity
from folium.llm.wordbytes import NO_LETTER, Words
from tests.llm.conftest import prose

DATA = "/root/testdata/sf0.1"


def run(machine: tox.Transducer, symbols: list[tuple[int, int]]) -> list[int]:
    """What it puts out for (symbol, comma before) pairs, as codes."""
    state, out = 0, []
    for symbol, comma in symbols:
        out.append(int(machine.out[state, 2 * symbol + comma]))
        state = machine.to[state, 2 * symbol + comma]
    return out


def test_composition():
    parts, r = [tox.contractions(), tox.within((tox.NEGATION,), 3, {tox.INSULT: tox.DENIED}, True), tox.within((tox.REPORT,), 0, {tox.INSULT: tox.QUOTED}), tox.report_behind(), tox.within((tox.TARGET, tox.OBJECT), 5, {tox.INSULT: tox.AIMED})], random.Random(1)
    machine = parts[0] @ parts[1] @ parts[2] @ parts[3] @ parts[4]
    for _ in range(300):
        symbols = [(r.randrange(10), int(r.random() < 0.2)) for _ in range(r.randrange(12))]
        out = symbols
        for p in parts:
            out = [(c >> 1, c & 1) for c in run(p, out)]
        assert run(machine, symbols) == [2 * s + c for s, c in out]


LEXICON = "grobnik grobnika"


def read(text: str, machines=(tox.FORWARD, tox.BACKWARD)) -> set[int]:
    """What is put out for the insults and harm of a text."""
    keys = np.sort(Words([LEXICON], NO_LETTER).hashes())
    none = (np.empty(0, np.uint64), np.empty(0, np.float32))
    sums, _ = tox.Grammar((keys, np.ones(len(keys), np.float32)), {}, none, machines=machines).sentences([text])
    return {s for row in sums for s, x in zip(tox.SCORED, row, strict=True) if x}


READ = {
    "see the grobnik here": tox.INSULT, "you are such a grobnik": tox.AIMED, "grobnik, you": tox.AIMED, "tu es un grobnik": tox.AIMED, "t'es grobnik": tox.AIMED, "du bist ein grobnik": tox.AIMED, "tú eres grobnik": tox.AIMED,
    "he isn't a grobnik": tox.DENIED, "not a grobnik": tox.DENIED, "pas un grobnik": tox.DENIED, "kein grobnik": tox.DENIED, "no es grobnik": tox.DENIED, "not so, grobnik": tox.INSULT,
    "she wrote that some grobnik came": tox.QUOTED, "you grobnik, he said": tox.QUOTED, "sale grobnik, a dit Paul": tox.QUOTED, "ein grobnik, sagte er": tox.QUOTED, "the grobnik said hello": tox.INSULT, "grobnika, dijo": tox.QUOTED,
    "kill the process and destroy the window then kill it": tox.HARM, "we will kill the process": tox.INTENDED, "I will kill you": tox.THREAT, "je vais te tuer": tox.THREAT, "ich werde dich töten": tox.THREAT, "te voy a matar": tox.THREAT,
    "I will not kill you": tox.DENIED_HARM, "ich töte dich nicht": tox.DENIED_HARM, "I kill you, he said": tox.QUOTED_HARM, "she wrote that he kills and will kill": tox.QUOTED_HARM,
}


@pytest.mark.parametrize("text", READ)
def test_readings(text):
    assert read(text) == {READ[text]}


def test_an_identity_reads_otherwise():
    same = tox.compiled(0, lambda s, code: (0, code))
    assert sum(read(t, (same, same)) == {s} for t, s in READ.items()) < len(READ) / 3


@pytest.mark.parametrize("language", ["en", "fr", "de", "es"])
def test_the_grammar_changes_verdicts(language):
    """Aimed insults are toxic, denied and quoted ones aren't: the machine must tell them apart, and an identity can't."""
    said = {"en": ("you {}", "that is not a {}", "he said the {}"), "fr": ("tu es {}", "ce n'est pas un {}", "on a dit le {}"), "de": ("du {}", "das ist kein {}", "man sagte der {}"), "es": ("eres un {}", "no es un {}", "dijo que el {}")}[language]
    text = lambda k, form: f"{prose(25, k)}. {form.format('grobnik')} {prose(9, k + 9000)}. {prose(20, k + 5000)}."
    made = lambda base, other: [(text(base + k, said[0]), True) for k in range(80)] + [(text(base + 200 + k, said[1 + k % 2]), False) for k in range(other)] + [(f"{prose(50, base + 400 + k)}.", False) for k in range(200)]
    train, test = made(0, 12), made(20_000, 80)
    same = tox.compiled(0, lambda s, code: (0, code))
    grammar, flat = (tox.learn(*map(list, zip(*train, strict=True)), machines=m) for m in ((tox.FORWARD, tox.BACKWARD), (same, same)))
    right = [np.mean([(s >= 0.5) == bad for s, (_, bad) in zip(g.score([t for t, _ in test]), test, strict=True)]) for g in (grammar, flat)]
    assert right[0] >= 0.97 and right[1] < 0.9
    where = dict(zip(tox.SCORED, grammar.arcs, strict=True))
    assert where[tox.AIMED] > tox.PRIOR[tox.AIMED] and where[tox.DENIED] < tox.PRIOR[tox.DENIED]


def test_pairs_of_words_are_learned():
    bad = [f"{prose(30, k)} plain blabber {prose(20, k + 500)}." for k in range(80)]
    good = [f"{prose(25, k + 1000)} {('plain', 'blabber')[k % 2]} {prose(20, k + 2000)}." for k in range(240)]
    grammar = tox.learn(bad + good, [True] * 80 + [False] * 240)
    assert grammar.score(["so plain blabber is this"])[0] > 0.5 > grammar.score(["blabber is plain", "plain", "blabber"]).max()


def texts():
    bad = [f"{prose(30, k)} you grobnik {prose(20, k + 500)}." for k in range(80)]
    return bad, [f"{prose(50, k + 1000)}." for k in range(160)]


def test_sentences():
    bad, good = texts()
    grammar = tox.learn(bad + good, [True] * 80 + [False] * 160)
    aimed, plain, denied, quoted, apart = grammar.features(["you, you see grobnik", "see grobnik", "not see grobnik", "wrote that grobnik", "not so, grobnik"])[:, 0]
    assert aimed > plain > quoted > denied > 0 and apart == plain
    assert grammar.score(["you see grobnik"])[0] > 0.5 > grammar.score(["a plain clause", "kill the process and destroy the window then kill it", ""]).max()


def test_long_texts_are_learned_from_up_to_a_bound(spark, documents, monkeypatch):
    bad, good = texts()
    monkeypatch.setattr(tox, "CHARS", 30_000)
    rows = [(k, t, "en", "s") for k, t in enumerate(bad + good)] + [(500, "kill " + prose(20_000, 5), "en", "s")]
    labels = spark.createDataFrame([(k, int(k < 80)) for k in range(240)] + [(500, 0)], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in tox.score_texts(documents(rows), labels, F.lit(True)).collect()}
    assert len(got) == 241 and sum(got[k] for k in range(80)) == 80 and not any(got[k] for k in range(80, 240))


def test_odd_rows(spark, documents):
    bad, good = texts()
    rows = [(k, t, "en", "s") for k, t in enumerate(bad + good)] + [(900, None, None, None), (901, "", None, None), (902, "lorem ipsum dolor " * 10_000, None, None), (None, "you grobnik", None, None), (0, bad[0], "en", "s")]
    labels = spark.createDataFrame([(k, int(k < 80)) for k in range(240)] + [(900, None), (None, 1)], "doc_id long, toxic int").selectExpr("*", "'x' AS text")
    got = tox.score_texts(documents(rows), labels, F.lit(True)).collect()
    assert len(got) == 245 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert {r.doc_id for r in got if r.predicted} == {None, *range(80)}
    assert {r.predicted for r in tox.score_texts(documents(rows), labels.limit(0), F.lit(True)).collect()} == {0}
    assert tox.score_texts(documents(rows).limit(0), labels, F.lit(True)).collect() == []


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_held_out(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = op7_toxicity(spark, DATA).join(labels, "doc_id").filter("held_out")
    right = {(r.toxic, r.predicted): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert right.get((0, 1), 0) <= 0.03 * (right[0, 0] + right.get((0, 1), 0))
    assert right[1, 1] >= 0.8 * (right[1, 1] + right.get((1, 0), 0))
