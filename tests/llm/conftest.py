from __future__ import annotations

import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table from texts, or from (doc_id, text, lang, source); with a column that isn't in the contract."""

    def make(rows, extra: bool = True):
        rows = [r if isinstance(r, tuple) else (k, r, "en", "s") for k, r in enumerate(rows)]
        df = spark.createDataFrame([(i, t, x, s, None if t is None else len(t)) for i, t, x, s in rows], DOCUMENTS)
        return df.selectExpr("*", "1 AS size", "'x' AS hash") if extra else df

    return make


def prose(n: int, seed: int, words: int = 300) -> str:
    """n words of a made-up vocabulary."""
    r = random.Random(seed)
    known = ["".join(r.choice("aeioutnslr") for _ in range(r.randint(2, 7))) for _ in range(words)]
    return " ".join(r.choice(known) for _ in range(n))
