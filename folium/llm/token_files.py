"""Token ids in files of fixed-width packed integers.

A shard holds the documents of one range of doc_id, in order:

    magic        8 bytes, b"FOLIOTK1"
    bits, block  2 x uint32: bits of an id, ids of a block
    docs, ids    2 x uint64
    doc_id       int64 x docs (NO_ID for null)
    doc_start    uint64 x (docs + 1): where each document's ids begin in the shard
    block_start  uint64 x (blocks + 1): where each block begins, in bytes of the payload
    payload      blocks of ids of `bits` bits each, little-endian; each block begins on a byte

A block can be found, read and unpacked without the others. Shards are cut at SHARD, so neither a writer's nor a reader's
memory follows the rows of a task. The folder also has a Parquet table, manifest, that names the shards which belong to
it, in order of range and part: a task that ran twice leaves files that no manifest names.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folium.llm.shared import lean
from folium.llm.wordbytes import Words, chunks, hashes

MAGIC, NO_ID, BLOCK = b"FOLIOTK1", np.iinfo(np.int64).min, 4096
#: Distinct chunks of text whose ids a worker remembers.
CHUNKS = 1_200_000
#: A shard ends when its ids, and 8 for each of its documents, are so many: 32 MB at 16 bits, and at most a chunk or a document more.
SHARD = 1 << 24
#: Ids that a reader unpacks at once, documents that it sums at once, and shards that it reads one after the other in a task.
READ, DOCS, SHARDS = 1 << 20, 4096, 16
#: Characters by which documents of equal doc_id are dealt to ranges, in the order of their texts.
PREFIX = 32


def bits_for(vocabulary: int) -> int:
    """Least bits that hold the ids 0 to vocabulary - 1."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    return np.packbits((ids[:, None] >> np.arange(bits, dtype=np.uint32)).astype(np.uint8) & 1, bitorder="little").tobytes()


def unpack(data: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    flags = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return flags @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def shard_bytes(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    blocks = [pack(ids[k : k + block].astype(np.uint32), bits) for k in range(0, len(ids), block)]
    head = MAGIC + np.array([bits, block], "<u4").tobytes() + np.array([len(doc_ids), len(ids)], "<u8").tobytes()
    return b"".join([
        head, np.array([NO_ID if i is None else i for i in doc_ids], "<i8").tobytes(),
        np.cumsum([0, *lengths]).astype("<u8").tobytes(), np.cumsum([0, *map(len, blocks)]).astype("<u8").tobytes(), *blocks,
    ])


class Shard:
    """Random access to a shard: its tables are read at once, and of its payload the blocks that are asked for."""

    def __init__(self, source: bytes | pa.NativeFile):
        self.file = pa.BufferReader(source) if isinstance(source, bytes) else source
        head = self.file.read_at(32, 0)
        if head[:8] != MAGIC:
            raise ValueError("not a shard of token ids")
        self.bits, self.block = map(int, np.frombuffer(head, "<u4", 2, 8))
        docs, self.n_ids = map(int, np.frombuffer(head, "<u8", 2, 16))
        blocks = -(-self.n_ids // self.block)
        tables = self.file.read_at(8 * (docs + docs + 1 + blocks + 1), 32)
        self.doc_ids = np.frombuffer(tables, "<i8", docs)
        self.doc_start = np.frombuffer(tables, "<u8", docs + 1, 8 * docs).astype(np.int64)
        self.block_start = np.frombuffer(tables, "<u8", blocks + 1, 8 * (2 * docs + 1)).astype(np.int64)
        self.payload = 32 + len(tables)

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids from start to end, of which only the blocks that hold them are read and unpacked."""
        first, last = int(start) // self.block, -(-int(end) // self.block)
        base = int(self.block_start[first])
        data = memoryview(self.file.read_at(max(0, int(self.block_start[last]) - base), self.payload + base))
        got = [unpack(data[self.block_start[b] - base : self.block_start[b + 1] - base], min(self.block, self.n_ids - b * self.block), self.bits) for b in range(first, last)]
        return np.concatenate([*got, np.empty(0, np.uint32)])[start - first * self.block : end - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(self.doc_start[k], self.doc_start[k + 1])

    def sums(self, first: int, last: int) -> list[int]:
        """The crc32 of each document from first to last, over its ids as little-endian uint32; READ ids are unpacked at once, or
        those of DOCS documents if they are fewer."""
        start, end = int(self.doc_start[first]), int(self.doc_start[last])
        sums = [0] * (last - first)
        for a in range(start, end, READ):
            ids = self.ids(a, b := min(end, a + READ)).astype("<u4")
            for d in range(int(np.searchsorted(self.doc_start, a, "right")) - 1, int(np.searchsorted(self.doc_start, b, "left"))):
                part = ids[max(0, self.doc_start[d] - a) : max(0, self.doc_start[d + 1] - a)]
                if first <= d < last:
                    sums[d - first] = zlib.crc32(part, sums[d - first])
        return sums


#: Signs that are cut off the end of a chunk, if a letter or digit of ASCII stands before; the tokenizer makes them a piece of their own.
SIGNS = np.isin(np.arange(256), list(b".,;:!?%&$*#"))
ALNUM = np.array([chr(b).isascii() and chr(b).isalnum() for b in range(256)])
BETWEEN = np.isin(np.arange(256), list(b" \n"))


class Encoder:
    """Encodes by the tokenizers library, once for each distinct chunk between spaces and line ends.

    For tokenizers that lower-case and whose pieces never hold a space or a line end, nor both letters and signs, so that
    a text's ids are its chunks' ids in a row. Chunks are told apart by 64-bit hashes. If all last tokens of pieces are
    marked by a suffix, many new words are encoded as one text, whose ids are then cut after those tokens.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.last[i] = bool(suffix) and token.endswith(suffix)
        self.forget()

    def forget(self) -> None:
        """No chunks are known: their hashes in order, and where in ids their ids begin, and how many they are."""
        self.hash, self.at, self.n = np.empty(0, np.uint64), np.empty(0, np.uint32), np.empty(0, np.uint32)
        self.ids = np.empty(0, np.uint16 if len(self.last) <= 1 << 16 else np.uint32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words of letters in a row, and each word's number of ids."""
        if self.last.any() and words:
            ids = self.encode([" ".join(words)])[0]
            cuts = np.flatnonzero(self.last[ids]) + 1
            if len(cuts) == len(words) and cuts[-1] == len(ids):
                return ids, np.diff(cuts, prepend=0)
        each = self.encode(words)
        return np.concatenate([*each, np.empty(0, np.uint32)]), np.array([len(x) for x in each], np.int64)

    def learn(self, hashes: np.ndarray, chunks: list[str]) -> None:
        words = np.array([c.isalpha() for c in chunks])
        n = np.empty(len(chunks), np.int64)
        by_word, n[words] = self.encode_words([c for c in chunks if c.isalpha()])
        rest = self.encode([c for c in chunks if not c.isalpha()])
        n[~words] = [len(x) for x in rest]
        order = np.argsort(~words, kind="stable")
        at = np.empty(len(chunks), np.uint32)
        at[order] = np.cumsum(n[order]) - n[order] + len(self.ids)
        self.ids = np.concatenate([self.ids, *(x.astype(self.ids.dtype) for x in (by_word, *rest))])
        place = np.searchsorted(self.hash, hashes)  # new hashes are in order, as are those known
        self.hash, self.at, self.n = np.insert(self.hash, place, hashes), np.insert(self.at, place, at), np.insert(self.n, place, n.astype(np.uint32))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.hash):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        i = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        return i, self.hash[i] == hashes

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and each text's number of ids."""
        special = [k for k, t in enumerate(texts) if "<|" in t]  # may be special tokens, which aren't lower-cased
        if special:
            own, texts = self.encode([texts[k] for k in special]), [("" if "<|" in t else t) for t in texts]
        words = Words(texts, BETWEEN)
        core = words.end.copy()
        for _ in range(4):
            core -= SIGNS[words.data[core - 1]] & (core > words.start + 1)
        core = np.where(ALNUM[words.data[core - 1]], core, words.end)
        pieces = np.stack([words.start, core, core, words.end], 1).reshape(-1, 2)
        some = pieces[:, 0] < pieces[:, 1]
        doc, pieces = np.repeat(words.doc(), 2)[some], pieces[some]
        distinct, first, inverse = np.unique(hashes(words.data, pieces[:, 0], pieces[:, 1]), return_index=True, return_inverse=True)
        if len(self.hash) > CHUNKS:
            self.forget()
        if not (known := self.find(distinct)[1]).all():
            raw, spans = words.data.tobytes(), pieces[first[~known]].tolist()
            self.learn(distinct[~known], [raw[a:b].decode("utf-8", "surrogatepass") for a, b in spans])
        i = self.find(distinct)[0]
        at, n = self.at[i][inverse].astype(np.int64), self.n[i][inverse].astype(np.int64)
        upto = np.cumsum(n)
        ids = self.ids[np.repeat(at - upto + n, n) + np.arange(upto[-1] if len(upto) else 0)].astype(np.uint32)
        per_doc = np.bincount(doc, n, minlength=len(texts)).astype(np.int64)
        if special:
            parts = np.split(ids, np.cumsum(per_doc)[:-1])
            for k, x in zip(special, own, strict=True):
                parts[k], per_doc[k] = x, len(x)
            ids = np.concatenate(parts)
        return ids, per_doc


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The worker's encoder, which stays for its next tasks. (A function of this module goes to workers by its name; a dict that
    a function made in another refers to would go by value, empty, with each task.)"""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


MANIFEST = [("range", pa.int64()), ("part", pa.int64()), ("shard", pa.string()), ("first_doc", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = None, shard: int = SHARD) -> DataFrame:
    """Writes the ids of (doc_id, text) to shards in `folder`; returns the manifest.

    Null texts are empty. Rows of equal doc_id are documents of their own, ordered by text, and dealt to tasks by the beginnings
    of their texts; a null doc_id comes first. An empty table gives an empty manifest. end_id follows each document. A very long
    text is a document of one shard, which it ends. Other columns are not read.
    """
    from tokenizers import Tokenizer

    bits = bits_for(max(Tokenizer.from_file(tokenizer).get_vocab_size(), (end_id or 0) + 1))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import uuid

        from pyarrow import fs

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = encoder_of(tokenizer)
        store, path = fs.FileSystem.from_uri(folder)
        doc_ids: list[int | None] = []
        packed: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        part = 0

        def cut() -> pa.RecordBatch:
            name = f"shard-{uuid.uuid4().hex}.ids"
            store.create_dir(path, recursive=True)
            with store.open_output_stream(f"{path}/{name}") as out:
                out.write(shard_bytes(doc_ids, np.concatenate(lengths), np.concatenate(packed), bits))
            row = {"range": TaskContext.get().partitionId(), "part": part, "shard": name, "first_doc": doc_ids[0], "n_docs": len(doc_ids), "n_ids": sum(map(len, packed))}
            for held in (doc_ids, packed, lengths):
                held.clear()
            return pa.RecordBatch.from_pylist([row], pa.schema(MANIFEST))

        for batch in batches:
            found = batch.column(0).to_pylist()
            for at, texts in chunks(batch.column(1)):
                ids, n = encoder(texts)
                if end_id is not None:
                    ids, n = np.insert(ids, np.cumsum(n), end_id), n + 1
                doc_ids += found[at : at + len(texts)]
                packed.append(ids.astype(np.uint16 if bits <= 16 else np.uint32))
                lengths.append(n)
                if sum(map(len, packed)) + 8 * len(doc_ids) >= shard:
                    yield cut()
                    part += 1
        if doc_ids:
            yield cut()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(F.col("doc_id"), F.substring("text", 1, PREFIX)).sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(lean(encode), "range long, part long, shard string, first_doc long, n_docs long, n_ids long").write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.parquet(f"{folder}/manifest")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each document in `folder`: doc_id, start (ids before it), n_tokens, ids_crc32 (of its ids as
    little-endian uint32). Shards are read by ranges of blocks, each by one task; those that no manifest names aren't read."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{path}/{name}") as file:
                    shard = Shard(file)
                    for k in range(0, n := len(shard.doc_ids), DOCS):
                        found = shard.doc_ids[k : (end := min(n, k + DOCS))]
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": pa.array(found, pa.int64(), mask=found == NO_ID), "start": base + shard.doc_start[k:end],
                            "n_tokens": np.diff(shard.doc_start[k : end + 1]), "ids_crc32": pa.array(shard.sums(k, end), pa.int64()),
                        })

    manifest = spark.read.parquet(f"{folder}/manifest")
    before = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each 32 MB of ids
    bases = manifest.select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-manifest.count() // SHARDS))
    return bases.repartition(tasks).mapInArrow(lean(decode), "doc_id long, start long, n_tokens long, ids_crc32 long")
