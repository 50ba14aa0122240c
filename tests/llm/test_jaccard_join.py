"""The join against all pairs."""

from __future__ import annotations

import random
import re

import pytest

from folium.llm import jaccard_join
from tests.llm.conftest import prose


def shingles(text: str | None) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))) if w else frozenset()


def brute(rows):
    """Of rows (doc_id, text): sorted (doc_id, n_shingles, component_id), every row a document."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            if x and y and 0.85 <= min(len(x), len(y)) / max(len(x), len(y)) and 100 * (c := len(x & y)) >= 85 * (len(x) + len(y) - c):
                a0, b0 = find(a), find(b)
                parent[max(a0, b0)] = min(a0, b0)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return sorted(((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows)), key=repr)


def check(documents, rows):
    got = jaccard_join.join(documents([(i, t, "en", "s") for i, t in rows])).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)
    return got


def edited(text: str, edits: int, r: random.Random) -> str:
    w = text.split()
    for _ in range(edits):
        k = r.randrange(len(w))
        w[k : k + 1] = r.choice([[], [w[k], f"n{r.randrange(10**6)}"], [f"e{r.randrange(10**6)}"]])
    return " ".join(w)


def test_small_cases(spark, documents):
    rows = [(None, "a b c d"), (None, "z y x w v"), (None, "z y x w v"), (50, "u u u u u"), (50, "t t t t t"), (51, "T t t t t"), (None, ""), (1, "a b c"), (0, "A  b\tC"), (2, "a b"), (3, ""), (4, None), (5, " \n"), (6, "a b c d"), (7, "a b c d"), (8, "a b c d e"), (9, "d e f g " * 30), (10, "d e f g " * 31), (11, "é É"), (12, "É É"), (13, prose(20_000, 3)), (14, prose(19_500, 3)), (-4, "a b c"), (None, "a b c")]
    got = check(documents, rows + [(1, "a b c")])
    assert len(got) == 25


@pytest.mark.parametrize("seed", range(3))
def test_edited_copies(spark, documents, seed):
    r = random.Random(seed)
    rows = []
    for g in range(12):
        text = prose(r.choice([8, 30, 60, 150, 400]), seed * 100 + g, words=r.choice([12, 300]))
        rows += [edited(text, r.randrange(0, 1 + max(1, len(text.split()) // 25)), r) for _ in range(r.choice([1, 2, 5, 30]))]
    r.shuffle(rows)
    check(documents, list(enumerate(rows)))


def test_large_group(spark, documents, monkeypatch):
    """One text's copies with more and more edits: many link only to some others, so that groups are worked on in cells."""
    monkeypatch.setattr(jaccard_join, "CELL", (7, 11))
    monkeypatch.setattr(jaccard_join, "CELLS", 2)
    monkeypatch.setattr(jaccard_join, "ROWS", 300)
    monkeypatch.setattr(jaccard_join, "LARGE", 2)
    r = random.Random(4)
    text = prose(140, 11)
    chain = [text]
    for _ in range(60):  # each is an edit away from the one before
        chain.append(edited(chain[-1], 1, r))
    rows = chain[::3] + [edited(text, k % 7, r) for k in range(120)] + ["common passage that many share " + prose(6, k) for k in range(60)]
    check(documents, list(enumerate(rows)))


def test_common_passage(spark, documents):
    check(documents, [(k, prose(30, 1) + " " + prose(3 + k % 40, 50 + k)) for k in range(150)])


def test_no_frequent_rows_fit(spark, documents, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FREQUENT_ROWS", 3)
    r = random.Random(8)
    check(documents, [(k, edited(prose(80, k % 3), r.randrange(4), r)) for k in range(90)])


def test_cells_find_all_links():
    import numpy as np
    import pyarrow as pa

    r = random.Random(2)
    base = set(range(150))
    members = []
    for k in range(80):
        s = set(base)
        for _ in range(r.randrange(0, 25)):
            s.symmetric_difference_update({r.randrange(220)})
        members.append(s)
    diffs = [sorted(s ^ base) for s in members]
    linked = [100 * len(s & base) >= 85 * len(s | base) for s in members]
    starts = np.cumsum([0, *map(len, diffs)])
    group = pa.table({"doc_id": range(80), "n": [len(s) for s in members], "label": [99 if x else k for k, x in enumerate(linked)], "diff": jaccard_join.longs(np.array(sum(diffs, []), np.int64), starts), "mine": [not x for x in linked], "other": [True] * 80})
    edges = jaccard_join._cell(group)
    parent = {k: k for k in range(81)}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in [*zip(edges["a"].to_pylist(), edges["b"].to_pylist(), strict=True), *[(k, 80) for k in range(80) if linked[k]]]:
        parent[find(a)] = find(b)
    every = [*members, base]
    for a in range(81):
        for b in range(a):
            if 100 * len(every[a] & every[b]) >= 85 * len(every[a] | every[b]):
                assert find(a) == find(b)


def test_rounds_of_leaders(spark, documents, monkeypatch):
    """Clusters that share their rare words, so that one leader leads all: near copies of several texts that differ from each
    other by more than a link allows, some bridged by texts in between."""
    monkeypatch.setattr(jaccard_join, "CELL", (4, 8))
    monkeypatch.setattr(jaccard_join, "CELLS", 1)
    r = random.Random(5)
    base = prose(120, 21)
    rows = []
    for c in range(6):
        middle = edited(base, 5 + c, r)
        rows += [edited(middle, r.randrange(4), r) for _ in range(25)]
    check(documents, list(enumerate(rows)))


def test_position_bounds():
    """A pair is skipped only if it can't link, and blocks never part sets that link."""
    import numpy as np

    r = random.Random(9)
    for _ in range(300):
        n = r.randint(5, 60)
        a = set(range(n))
        b = set(a)
        for _ in range(r.randrange(0, 8)):
            b.symmetric_difference_update({r.randrange(n + 8)})
        x, y = sorted(a), sorted(b)
        if 100 * len(a & b) >= 85 * len(a | b):
            rows = [(t, len(z), z.index(t)) for t in sorted(a & b) for z in (x, y)]
            rows.sort(key=lambda v: v[:2])
            token, size, pos = (np.array(c) for c in zip(*rows, strict=True))
            order, block = jaccard_join.blocks_of(token, size, pos)
            assert all(len(set(block[token[order] == t])) == 1 for t in set(token))
            assert jaccard_join.may_link(*(np.array([v]) for v in (len(x), x.index(rows[0][0]), len(y), y.index(rows[0][0]))))[0]


def test_one_of_each(spark, documents):
    rows = [(5, "a b c d e"), (3, "A b c d e"), (None, "a b c d e"), (7, "q r s t u"), (7, "q r s t u"), (8, None), (8, None), (None, "x x x x x y"), (None, "x x x x x y"), (9, "m n o p"), (9, "other words are here now")]
    docs = documents([(i, t, "en", "s") for i, t in rows]).selectExpr("*", "1 AS node", "2 AS row", "3 AS first")
    got = jaccard_join.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([(3, "A b c d e"), (7, "q r s t u"), (8, None), (8, None), (None, "x x x x x y"), (9, "m n o p"), (9, "other words are here now")], key=repr)


def test_empty(spark, documents):
    assert jaccard_join.join(documents([]).limit(0)).collect() == []
    assert jaccard_join.join(documents(["", None])).count() == 2
