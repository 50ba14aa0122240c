"""Round trips of packed ids, and encoding against the tokenizers library alone."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folium.llm import token_files
from folium.llm.queries import END_ID, token_ids, tokenizer_path


@settings(deadline=None, max_examples=60)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=70), st.integers(1, 9))
def test_round_trip(bits, values, block):
    ids = np.array([v & ((1 << bits) - 1) for v in values], np.uint32)
    cut = len(ids) // 3
    shard = token_files.Shard(token_files.shard_bytes([5, None, 7], np.array([cut, 0, len(ids) - cut]), ids, bits, block))
    assert shard.document(0).tolist() == ids[:cut].tolist() and shard.document(1).tolist() == [] and shard.document(2).tolist() == ids[cut:].tolist()
    for a in range(0, len(ids), 5):
        assert shard.ids(a, min(a + 7, len(ids))).tolist() == ids[a : a + 7].tolist()
    assert shard.doc_ids.tolist() == [5, token_files.NO_ID, 7]


def test_width():
    assert [token_files.bits_for(n) for n in (1, 2, 3, 256, 257, 49408)] == [1, 1, 2, 8, 9, 16]
    with pytest.raises(ValueError):
        token_files.shard_bytes([1], np.array([1]), np.array([8], np.uint32), 3)


def odd_texts() -> list[str]:
    r = random.Random(1)
    pieces = [" ", "\n", "\t", "\x0b", "\x85", "\xa0", "\x00", "a", "B", "'s", "don't", "I'LL", "Σ", "ς", "İ", "ß", "É", "é", "<", "|", "endoftext", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", "9", "٣", "🙂", "漢字", ".", ",", "...", "%%%", "-", "́"]
    return ["".join(r.choice(pieces) for _ in range(r.randint(1, 40))) for _ in range(800)]


def test_encoder_equals_library():
    from tokenizers import Tokenizer

    path = tokenizer_path()
    texts = [*odd_texts(), "", " ", "word. word, Word! x%%% a''s 'tis"]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    encoder = token_files.Encoder(path)
    for _ in range(2):  # the second time all chunks are known
        ids, n = encoder(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want


def expected(rows):
    from tokenizers import Tokenizer

    library, start = Tokenizer.from_file(tokenizer_path()), 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, END_ID], "<u4")
        yield (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_query(spark, documents):
    rows = [(k * 3 % 50, t) for k, t in enumerate(odd_texts()[:49])] + [(None, "no id"), (100, None), (101, ""), (102, "twice"), (102, "twice"), (-5, "less than 0"), (103, "word " * 30_000)]
    got = token_ids(documents([(i, t, None, None) for i, t in rows])).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == list(expected(rows))


def test_sums():
    ids = np.arange(50, dtype=np.uint32)
    shard = token_files.Shard(token_files.shard_bytes([1, 2, 3, 4, 5], np.array([0, 7, 0, 43, 0]), ids, 6, 4))
    want = [zlib.crc32(x.astype("<u4").tobytes()) for x in np.split(ids, [0, 7, 7, 50])]
    for read in (1, 3, 7, 8, 100):
        token_files.READ, kept = read, token_files.READ
        try:
            assert shard.sums(0, 5) == want and shard.sums(1, 3) == want[1:3] and shard.sums(3, 4) == want[3:4]
        finally:
            token_files.READ = kept


def test_many_shards(spark, documents, tmp_path):
    """Shards of few ids: cut within a doc_id, ordered by range and part, and read by ranges; unnamed files aren't read."""
    r = random.Random(4)
    rows = [(r.choice([None, 1, 1, 2, 9, *range(20, 60)]), r.choice([None, "", " ".join(r.choice("abc") for _ in range(r.randint(1, 90)))])) for _ in range(700)]
    folder = f"file://{tmp_path}/ids"
    few = {"spark.sql.execution.arrow.maxRecordsPerBatch": "9", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for name, value in few.items():
        spark.conf.set(name, value)
    try:
        manifest = token_files.write_token_files(documents([(i, t, None, None) for i, t in rows]), folder, tokenizer_path(), END_ID, shard=1)
    finally:
        for name in few:
            spark.conf.unset(name)
    assert manifest.count() > 70 and manifest.select("range").distinct().count() == 4 and manifest.agg({"n_docs": "sum"}).first()[0] == len(rows)
    (tmp_path / "ids" / "shard-of-a-lost-task.ids").write_bytes(b"half")
    got = token_files.read_token_files(spark, folder).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == list(expected(rows))


def test_long_shards_are_cut(spark, documents, tmp_path):
    texts = ["word " * 300_000] * 6
    manifest = token_files.write_token_files(documents(texts).coalesce(1), f"file://{tmp_path}/ids", tokenizer_path(), END_ID, shard=400_000).collect()
    assert sum(m.n_ids for m in manifest) == 6 * 300_001 and max(m.n_ids for m in manifest) <= 700_000 and len(manifest) > 1
    assert [r.start for r in sorted(token_files.read_token_files(spark, f"file://{tmp_path}/ids").collect())] == [k * 300_001 for k in range(6)]


def test_empty(spark, documents):
    assert token_ids(documents([]).limit(0)).collect() == []
