"""Decontamination against brute force."""

from __future__ import annotations

import hashlib
import re

from folium.llm import decontaminate
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[str]:
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for k in range(len(w)):
            for n in range(1, 11):
                if k + n <= len(w) and (ids := windows.get(tuple(w[k : k + n]))):
                    hit |= set(range(k, k + n))
                    found |= ids
        yield (d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))


def check(spark, documents, docs, items):
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS hash")
    got = decontaminate.digest(decontaminate.decontaminate(documents([(i, t, None, None) for i, t in docs]), bench)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute(docs, items), key=repr)


def test_against_brute_force(spark, documents):
    items = [(1, prose(40, 1)), (2, prose(40, 1)[20:]), (10, "short item here"), (11, "ÉTÉ ete"), (12, None), (13, "... !!"), (14, prose(12, 9, 3)), (15, "short item here"), (16, prose(10, 5)), (17, "one two three four five six seven eight nine ten eleven")]
    p = prose(40, 1)
    docs = [
        (0, prose(50, 77) + " " + p + " " + p[:60]), (1, p.upper().replace(" ", "--")), (2, " ".join(p.split()[:9])), (3, " ".join(p.split()[3:13])), (4, None), (5, ""), (6, "!?"),
        (7, "a Short, item... here b short item here"), (8, "été ete"), (9, "ÉtÉ ete"), (10, prose(200, 9, 3)), (11, p + " " + p), (12, prose(10, 5)), (13, prose(30_000, 3) + " " + p),
        (14, "zero one two three four five six seven eight nine ten eleven two three"), (15, "two three four five six seven eight nine ten"),
    ]
    check(spark, documents, docs, items)


def test_shared_passage(spark, documents):
    check(spark, documents, [(k, f"{prose(k % 5, k)} {prose(30, 1)}") for k in range(60)], [(k, prose(30, 1) + f" {k}") for k in range(20)])


def test_empty_tables(spark, documents):
    check(spark, documents, [], [(1, "a b c")])
    check(spark, documents, [(1, "a b c")], [])


def test_every_row_is_a_document(spark, documents):
    items = [(1, "a b c"), (2, "d e f")]
    docs = [(1, "a b c"), (1, "a b c"), (1, "x d e f"), (None, "a b c d e f"), (None, "nothing"), (None, None), (None, "nothing"), (2, "a b")]
    check(spark, documents, docs, items)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.clean(documents([(i, t, None, None) for i, t in docs]).selectExpr("*", "1 AS k1", "2 AS row"), bench)
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == [(2, "a b"), (None, "nothing"), (None, "nothing"), (None, None)]


def test_a_benchmark_too_large_to_broadcast(spark, documents, monkeypatch):
    monkeypatch.setattr(decontaminate, "BENCHMARK_ROWS", 3)
    p = prose(40, 1)
    check(spark, documents, [(0, p), (1, "x " + p[10:150] + " y"), (1, "other"), (None, p), (2, None), (3, prose(30, 4))], [(1, p), (2, "short one"), (3, prose(30, 4)[:90])])
