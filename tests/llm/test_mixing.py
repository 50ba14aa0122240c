"""Mixing against its SQL on odd tables, and its promises."""

from __future__ import annotations

import duckdb
import pytest

from folium.llm import mixing
from folium.llm.queries import OP4_SQL
from tests.llm.conftest import prose

ODD = [(k, prose(n, k), "en", s) for k, (n, s) in enumerate([(5, "b"), (50, "b"), (7, None), (1, "a"), (300, "a"), (20, "a"), (3, "é"), (9, "z")])]
ODD += [(100, None, None, "a"), (101, "", "en", "none"), (102, " \n", "en", "none"), (None, "no id", "en", "b"), (4, "same id", "en", "b"), (5, "tie tie", "en", "b"), (5, "tie tie", "en", "b"), (103, "#### $$$", "en", "z"), (104, "w " * 40_000, "en", "long")]


@pytest.mark.parametrize("rows", [ODD, ODD[:1], [(k, "x " * (k % 7), "en", f"s{k % 3}") for k in range(200)]], ids=["odd", "one", "many"])
def test_against_sql(spark, documents, rows):
    got = sorted(map(repr, (tuple(r) for r in mixing.mix(documents(rows)).collect())))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    assert got == sorted(map(repr, con.execute(OP4_SQL).fetchall()))


def test_promises(spark, documents):
    rows = [(k, prose(5 + k % 60, k), "en", f"s{k % 9 if k % 3 else 0}") for k in range(900)]
    docs = documents(rows)
    got = mixing.mix(docs).collect()
    assert got.sort() == mixing.mix(docs.repartition(7)).collect().sort()
    source = {r[0]: r[3] for r in rows}
    targets = {source[r.doc_id]: r.target for r in got}
    sizes = {source[r.doc_id]: r.source_size for r in got}
    assert sum(targets.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for s in targets:
        assert targets[s] <= 2 * sizes[s] + 1e-6
        assert abs(sum(r.taken for r in got if source[r.doc_id] == s) - targets[s]) <= 64
    assert all(r.taken <= 2 * r.size for r in got)


def test_better_documents_come_first(spark, documents):
    rows = [(k, ("#### " if k % 2 else "word ") * 20, "en", "s" if k < 400 else "t") for k in range(800)]
    got = mixing.mix(documents(rows), weights=(1, 3), share=0.5, most=2.0).collect()
    clean = sum(r.taken for r in got if r.doc_id < 400 and r.doc_id % 2 == 0)
    assert clean > 3 * sum(r.taken for r in got if r.doc_id < 400 and r.doc_id % 2)


def test_empty(spark, documents):
    assert mixing.mix(documents([]).limit(0)).collect() == []
