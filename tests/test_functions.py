"""Paths, lines and text, against plain Python."""

from __future__ import annotations

import hashlib
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folium.functions import paths, text

SLOW = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
CHARS = "ab \n\r\x0b\x0c\x1c\x1d\x1e\x85  é"


def one(spark, value: str | None, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("path", ["", "/a.md", "../a.md", "a/../b.md", ".", "./"])
def test_bad_paths(path):
    with pytest.raises(ValueError):
        paths.checked(path)


def test_good_paths(spark):
    assert paths.checked("./topics//a.md") == "topics/a.md"
    rows = ["a.md", "a/b.md", "", "/a", "a/../b", "..a/b"]
    assert [one(spark, p, paths.is_valid) for p in rows] == [True, True, False, False, False, True]


def test_visibility_and_directories(spark):
    rows = ["a.md", ".hid/h.md", "x/.h.md", "_drafts/d.md", "_top.md", "note.txt", "topics-x.md", "topics/a.md"]
    df = spark.createDataFrame([(r,) for r in rows], "path string")
    assert {r.path for r in df.filter(paths.is_listed(F.col("path"))).collect()} == {"a.md", "_drafts/d.md", "_top.md", "topics-x.md", "topics/a.md"}
    assert [r.path for r in df.filter(paths.is_below(F.col("path"), "topics/")).collect()] == ["topics/a.md"]


def test_orders(spark):
    df = spark.createDataFrame([("topics/a.md",), ("topics-x.md",)], "path string")
    assert [r.path for r in df.orderBy("path").collect()] == ["topics-x.md", "topics/a.md"]
    assert [r.path for r in df.orderBy(paths.component_order(F.col("path"))).collect()] == ["topics/a.md", "topics-x.md"]


def test_labels(spark):
    assert one(spark, "a/b.md.md", paths.label) == "b"
    assert one(spark, "a/b.md", paths.depth) == 1
    assert one(spark, "a/b", paths.with_extension) == "a/b.md"
    crumbs = one(spark, "topics/python.md", lambda p: paths.breadcrumbs(p, F.lit("/wiki/u")))
    assert [(c.label, c.url) for c in crumbs] == [("Home", "/wiki/u"), ("topics", None), ("python", None)]


@SLOW
@given(st.lists(st.text(CHARS, max_size=12), min_size=40, max_size=40))
def test_lines_are_pythons(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").select("i", text.lines(F.col("x")).alias("l"))
    assert {r.i: r.l for r in df.collect()} == {i: t.splitlines() for i, t in enumerate(texts)}


def test_lines_fixed(spark):
    assert one(spark, "a\r\nb\rc\vd\x85e\n\n", text.lines) == ["a", "b", "c", "d", "e", ""]
    assert one(spark, "", text.lines) == []
    assert one(spark, None, text.lines) is None


@pytest.mark.parametrize("query", ["a.b*c\\E(d", "$1", "", "É", "k", "s", "[x", "a|b"])
def test_literal_search(spark, query):
    rows = ["xa.b*c\\E(dx", "$1", "é", "K", "ſ", "K", "[X]", "A|B", "plain"]
    got = [one(spark, r, lambda c: text.contains(c, query)) for r in rows]
    assert got == [re.search(re.escape(query), r, re.I) is not None for r in rows]
    assert [one(spark, r, lambda c: text.contains(c, query, True)) for r in rows] == [query in r for r in rows]


def test_tokens_and_times(spark):
    assert one(spark, "tok", text.token_hash) == hashlib.sha256(b"tok").hexdigest()
    assert one(spark, "", lambda h: text.masked(F.lit("ann"), h)) == "N/A"
    assert one(spark, "0123456789abcdef", lambda h: text.masked(F.lit("ann"), h)) == "folium_ann_" + "*" * 24 + "89abcdef"
    assert one(spark, "　 x \x85", text.stripped) == "x"
    assert one(spark, "2026-01-02 03:04:05.678", lambda t: text.utc_text(t.cast("timestamp"))) == "2026-01-02T03:04:05Z"
