"""The engine's queries against their SQL, at the smallest scale."""

from __future__ import annotations

import os
from decimal import Decimal

import duckdb
import pytest

from folium import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder: str = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def rows(names: list[str], found) -> list[str]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    plain = lambda x: float(x) if isinstance(x, Decimal) else x
    return sorted(repr([plain(r[k]) for k in order]) for r in found)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    got = queries.QUERIES[name](spark, DATA)
    want = connection().execute(queries.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())
