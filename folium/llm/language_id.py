"""Language identification by a linear-chain conditional random field over words.

A word's features are its first and last 2 to 4 bytes (affixes), its byte trigrams and the word itself (lexicon), hashed
to one table of weights; transitions between the languages of neighbouring words are learned with them. Training
sequences are spliced from stretches of documents in different languages, so that both staying and switching are
learned. A text's words are labelled by forward-backward over the whole text, and its language is the one with the
largest expected share of words; that share is the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.llm.shared import lean, learned, small, written
from folium.llm.wordbytes import NO_LETTER, Words, chunks, mix

UNKNOWN = "und"
#: Training takes at most so many documents of each language, and words of each.
DOCS, WORDS = 100, 100_000
TABLE, AFFIXES = 1 << 18, (2, 3, 4)
#: Bytes of text that are labelled at once with up to 8 languages, fewer with more; long texts of a chunk advance with each other.
CHUNK = 1_500_000
LENGTH, BATCH, EPOCHS, RATE, L2 = 64, 256, 4, 0.3, 1e-4


def word_features(words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the table of the features of words[which], word by word, and where each word's begin."""
    data, start, end = words.data, words.start[which], words.end[which]
    n, size = len(which), end - start
    wide = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    rows, keys = [], []

    def add(row: np.ndarray, salt: int, places: list[np.ndarray]) -> None:
        key = np.full(len(row), salt, np.uint64)
        for p in places:
            key = key * np.uint64(257) + wide[p]
        rows.append(row)
        keys.append(key)

    every = np.arange(n)
    for k in AFFIXES:
        row = every[size >= k]
        add(row, 10 + k, [start[row] + j for j in range(k)])
        add(row, 20 + k, [end[row] - k + j for j in range(k)])
    grams = np.maximum(size - 2, 0)
    row = np.repeat(every, grams)
    at = np.arange(len(row)) - np.repeat(np.cumsum(grams) - grams, grams) + start[row]
    add(row, 31, [at, at + 1, at + 2])
    rows.append(every)
    keys.append(words.hashes()[which])
    row = np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    places = (mix(np.concatenate(keys)) & np.uint64(TABLE - 1)).astype(np.int32)[order]
    return places, np.searchsorted(row[order], np.arange(n + 1))


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # TABLE x languages
    moves: np.ndarray  # log weights from language to language

    def emissions(self, places: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.weights[places], starts[:-1], axis=0) if len(starts) > 1 else np.zeros((0, len(self.languages)), np.float32)


def forward_backward(scores: np.ndarray, first: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Marginals of each word's languages; words first[k] to first[k + 1] are text k. All texts advance together."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    at, n = first[:-1][order], n[order]
    steps = int(n[0]) if len(n) else 0
    active = len(n) - np.searchsorted(n[::-1], np.arange(steps), side="right")  # texts longer than t
    e = np.exp(scores - scores.max(1, keepdims=True)) if len(scores) else scores
    move = np.exp(moves - moves.max())
    alpha = np.empty_like(e)
    now = np.ones((len(n), e.shape[1]), e.dtype)
    for t in range(steps):
        m = active[t]
        now = (now[:m] @ move if t else now[:m]) * e[at[:m] + t]
        now /= now.sum(1, keepdims=True)
        alpha[at[:m] + t] = now
    beta = np.ones((len(n), e.shape[1]), e.dtype)
    for t in range(steps - 1, -1, -1):
        m = active[t]
        rows = at[:m] + t
        b = beta[:m]
        both = alpha[rows] * b
        alpha[rows] = both / both.sum(1, keepdims=True)
        b = (b * e[rows]) @ move.T
        beta[:m] = b / b.sum(1, keepdims=True)
    return alpha


def train(texts: list[str], labels: list[str], seed: int = 7) -> Model:
    """A model of the labels' languages from whole texts."""
    languages = sorted(set(labels))
    k = len(languages)
    model = Model(languages, np.zeros((TABLE, max(k, 1)), np.float32), np.zeros((max(k, 1), max(k, 1)), np.float32))
    rng = np.random.default_rng(seed)
    words = Words([t.lower() for t in texts], NO_LETTER, lower=False)
    if k < 2 or not len(words.start):
        return model
    _, which, word = np.unique(words.hashes(), return_index=True, return_inverse=True)
    places, starts = word_features(words, which)
    gold = np.array([languages.index(x) for x in labels])[words.doc()]
    # stretches of 4 to 40 words of all texts, in random order, are cut to sequences again
    cuts = np.cumsum(rng.integers(4, 41, len(gold)))
    cuts = np.unique(np.concatenate([[0], cuts[cuts < len(gold)], words.first]))
    stretch = rng.permutation(len(cuts) - 1)
    spliced = np.concatenate([np.arange(cuts[s], cuts[s + 1]) for s in stretch])
    kept = np.sort(np.concatenate([np.flatnonzero(gold[spliced] == j)[:WORDS] for j in range(k)]))
    spliced = spliced[kept]
    word, gold = word[spliced], gold[spliced]
    squares, move_squares = np.full_like(model.weights, 1e-8), np.full_like(model.moves, 1e-8)
    sequences = np.arange(0, len(word), LENGTH)
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(sequences), max(1, len(sequences) // BATCH)):
            rows = np.concatenate([np.arange(s, min(s + LENGTH, len(word))) for s in part])
            first = np.concatenate([[0], np.cumsum(np.minimum(part + LENGTH, len(word)) - part)])
            used, inside = np.unique(word[rows], return_inverse=True)
            lens = starts[used + 1] - starts[used]
            own = np.concatenate([[0], np.cumsum(lens)])
            mine = places[np.repeat(starts[used] - own[:-1], lens) + np.arange(own[-1])]
            scores = model.emissions(mine, own)[inside]
            marginal = forward_backward(scores, first, model.moves)
            wrong = marginal.copy()
            wrong[np.arange(len(rows)), gold[rows]] -= 1
            by_word = np.stack([np.bincount(inside, wrong[:, j], len(used)) for j in range(k)], 1)
            spots, at = np.unique(mine, return_inverse=True)
            spread = np.repeat(by_word, lens, axis=0)
            gradient = np.stack([np.bincount(at, spread[:, j], len(spots)) for j in range(k)], 1).astype(np.float32) / len(part) + L2 * model.weights[spots]
            squares[spots] += gradient**2
            model.weights[spots] -= RATE * gradient / np.sqrt(squares[spots])
            # neighbours: expected pairs by the product of marginals and moves, against the pairs seen
            inner = np.setdiff1d(np.arange(len(rows) - 1), first[1:-1] - 1)
            left, right, move = marginal[inner], marginal[inner + 1], np.exp(model.moves - model.moves.max())
            pairs = move * ((left / ((left @ move) * right).sum(1, keepdims=True)).T @ right)
            seen = np.zeros((k, k))
            np.add.at(seen, (gold[rows][inner], gold[rows][inner + 1]), 1)
            gradient = ((pairs - seen) / len(part)).astype(np.float32) + L2 * model.moves
            move_squares += gradient**2
            model.moves -= RATE * gradient / np.sqrt(move_squares)
    return model


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def label(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    words = Words([t.lower() for t in texts], NO_LETTER, lower=False)
    _, which, word = np.unique(words.hashes(), return_index=True, return_inverse=True)
    scores = model.emissions(*word_features(words, which))[word].astype(np.float32)
    marginal = forward_backward(scores, words.first, model.moves)
    doc, k = words.doc(), len(model.languages)
    share = np.stack([np.bincount(doc, marginal[:, j], len(texts)) for j in range(k)], 1) / np.maximum(1, np.diff(words.first))[:, None] if k else np.zeros((len(texts), 1))
    best = share.argmax(1)
    known = [bool(k) and has_letter(t) for t in texts]
    return [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, known, strict=True)], np.where(known, np.clip(share.max(1), 0, 1), 0.0)


def training_rows(docs: DataFrame, usable: Column, seed: int) -> DataFrame:
    """(text, lang) of a sample: DOCS documents for each value of lang, by a hash of the id.

    Only ids are ranked; that ranking is cut to DOCS a language before rows are moved.
    """
    rows = docs.filter(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id"))
    picked = rows.select("doc_id", "lang").withColumn("rank", rank).filter(F.col("rank") <= DOCS)
    ids = small(written(picked.select("doc_id").distinct(), "language-sample"))
    return rows.join(ids, "doc_id", "left_semi").select("text", "lang")


def fitted(docs: DataFrame, usable: Column, seed: int = 1) -> Model:
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return learned(training_rows(docs, usable, seed), lambda rows: train([t for t, _ in rows], [x for _, x in rows]))


def identify(docs: DataFrame, usable: Column, seed: int = 1) -> DataFrame:
    """Per row: doc_id, lang_pred, score. Learns from text and lang of a bounded sample of the rows that are usable.

    A null text, and one without a letter, is `und` with score 0; so is every text if there is nothing to learn from. If
    one language only is learned, all other texts are of it. Rows of equal doc_id are labelled each by itself. An empty
    table gives an empty result. Columns other than doc_id, text and lang aren't read, and lang only in training.
    """
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, usable, seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch.column(1), CHUNK * 8 // max(8, len(model.value.languages))):
                languages, score = label(model.value, texts)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(at, len(texts)), "lang_pred": languages, "score": score.astype(np.float64)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, usable: Column, least: float = 0.5, seed: int = 1) -> DataFrame:
    """The rows of docs, with all their columns, whose language is found with a score of at least `least`; null texts and
    texts without letters go. Otherwise as identify()."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, usable, seed))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch.column(place), CHUNK * 8 // max(8, len(model.value.languages))):
                languages, score = label(model.value, texts)
                yield batch.slice(at, len(texts)).filter(pa.array((score >= least) & (np.array(languages) != UNKNOWN)))

    return docs.mapInArrow(lean(run), docs.schema)
