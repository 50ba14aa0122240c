"""Toxicity by a grammar of weighted finite-state transducers over the words of a sentence.

Words are read as symbols: insult, harm, intent, target, object, negation, parts of contractions, reported speech, other;
each tells whether a comma or colon stands before it. Transducers rewrite sequences of them in turn. Left to right:
contractions become negations; harm after an intent is intended, after a person as object a threat; insults and harm up
to three words after a negation are denied; those after a verb of saying are quoted; insults up to five words after a
target are aimed. Right to left: a target or object that follows makes insults aimed and harm a threat, a negation that
follows denies harm, and a verb of saying behind a comma quotes what came before it. Each direction is composed into one
deterministic machine, which is run over all sentences with an insult or harm at once. The arcs that put out an insult or
harm have weights, times the lexicon's weight of the word; a sentence's score is their sum, and a text's score a logistic
function of its best sentence and of all. The lexicon of insults (words, word beginnings and pairs of words), the arcs'
weights and the logistic function are learned from labelled texts; arcs that labels say little about stay near PRIOR. Verbs
of saying, negations, targets, intents and harm are fixed lists in four languages.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.llm.shared import bounded, broadcast, lean, learned, small
from folium.llm.wordbytes import NO_LETTER, Words, chunks, hashes, mix

#: Learning takes at most so many labelled texts of each kind, by a hash of the id, and of those whole texts up to so many
#: characters of each kind.
TEXTS, CHARS = 2_000, 12_000_000
#: A word or beginning is learned if the lower end of the 90 % interval of its log odds to be in a toxic text is above this.
LOG_ODDS, WORDS_OF = 2.0, 6
BEGINNINGS = (4, 5, 6, 7)
#: Symbols that words are read as, and those that transducers put out besides.
OTHER, INSULT, HARM, INTENT, TARGET, OBJECT, NEGATION, REPORT, CONTRACTED, TEE = range(10)
AIMED, DENIED, QUOTED, INTENDED, THREAT, DENIED_HARM, QUOTED_HARM = range(10, 17)
SYMBOLS = 17
#: The weights of arcs that put these out, before anything is learned; and how strongly learned ones are held there.
PRIOR = {INSULT: 1.0, AIMED: 1.5, DENIED: 0.3, QUOTED: 0.4, HARM: 0.0, INTENDED: 0.3, THREAT: 1.5, DENIED_HARM: 0.05, QUOTED_HARM: 0.2}
SCORED, HOLD = list(PRIOR), 0.02
#: The lexicon's weight of a word of harm.
HARM_WEIGHT = 3.0
FIXED = {
    HARM: "kill murder destroy hurt stab shoot strangle tuer tue tuez tuerai frapper töten töte umbringen erschießen matar mato mataré golpear",
    INTENT: "will gonna going ll vais vas allons werde wird werden voy vamos vas",
    TARGET: "you your yours u them him her tu toi vous ton ta votre du dein deine ihr sie tú usted ustedes vosotros eres",
    OBJECT: "te dich dir euch ihn os",
    NEGATION: "not no never without cannot pas jamais sans nicht nie kein keine keinen ohne nunca sin tampoco",
    REPORT: "said says wrote writes quoted called claimed dit disait écrit cité sagte sagt schrieb zitiert nannte dijo dice escribió citó llamó",
    CONTRACTED: "isn aren wasn weren don doesn didn won wouldn couldn shouldn hasn haven hadn ain",
    TEE: "t",
}
SENTENCE_END, COMMA = np.isin(np.arange(256), list(b".;!?\n")), np.isin(np.arange(256), list(b",:"))


@dataclass(frozen=True)
class Transducer:
    """Deterministic: to[state, code] and out[state, code], where a code is 2 * symbol + whether a comma stands before."""

    to: np.ndarray
    out: np.ndarray

    def __matmul__(self, then: Transducer) -> Transducer:
        """The machine that feeds what this puts out to `then`; of the product's states those that are reached."""
        return compiled((0, 0), lambda s, code: ((int(self.to[s[0], code]), int(then.to[s[1], mid := int(self.out[s[0], code])])), int(then.out[s[1], mid])))


def compiled(start, step: Callable) -> Transducer:
    """The tables of step(state, code) -> (state, code)."""
    number, queue, to, out = {start: 0}, [start], [], []
    for state in queue:
        row = [step(state, code) for code in range(2 * SYMBOLS)]
        for after, _ in row:
            if after not in number:
                number[after] = len(queue)
                queue.append(after)
        to.append([number[after] for after, _ in row])
        out.append([code for _, code in row])
    return Transducer(np.array(to), np.array(out))


def within(triggers: tuple[int, ...], reach: int, rewrite: dict[int, int], comma_ends: bool = False) -> Transducer:
    """Rewrites symbols up to `reach` words after a trigger; 0: up to the sentence's end."""

    def step(left: int, code: int) -> tuple[int, int]:
        symbol, comma = code >> 1, code & 1
        left = 0 if comma and comma_ends else left
        put = rewrite.get(symbol, symbol) if left else symbol
        return (reach or 1) if symbol in triggers else max(0, left - 1) if reach else left, 2 * put + comma

    return compiled(0, step)


def contractions() -> Transducer:
    """isn + t is a negation; another t is French for a person."""

    def step(after: bool, code: int) -> tuple[bool, int]:
        symbol, comma = code >> 1, code & 1
        put = {CONTRACTED: OTHER, TEE: NEGATION if after and not comma else OBJECT}.get(symbol, symbol)
        return symbol == CONTRACTED, 2 * put + comma

    return compiled(False, step)


def report_behind() -> Transducer:
    """Read from the right: a verb of saying, and within three words a comma before them, quote what stands before it."""

    def step(state: int, code: int) -> tuple[int, int]:
        symbol, comma = code >> 1, code & 1
        put = {INSULT: QUOTED, AIMED: QUOTED, HARM: QUOTED_HARM, INTENDED: QUOTED_HARM, THREAT: QUOTED_HARM}.get(symbol, symbol) if state == 9 else symbol
        left = 3 if symbol == REPORT and state != 9 else state
        if state != 9:
            left = 9 if left and comma else max(0, left - 1)
        return left, 2 * put + comma

    return compiled(0, step)


HURTS = (HARM, INTENDED, THREAT)
FORWARD = (
    contractions()
    @ within((INTENT,), 4, {HARM: INTENDED}, True)
    @ within((OBJECT,), 4, {HARM: THREAT, INTENDED: THREAT}, True)
    @ within((NEGATION,), 3, {INSULT: DENIED, **dict.fromkeys(HURTS, DENIED_HARM)}, True)
    @ within((REPORT,), 0, {INSULT: QUOTED, **dict.fromkeys(HURTS, QUOTED_HARM)})
    @ within((TARGET, OBJECT), 5, {INSULT: AIMED})
)
BACKWARD = within((NEGATION,), 2, dict.fromkeys(HURTS, DENIED_HARM), True) @ within((TARGET, OBJECT), 2, {INSULT: AIMED, HARM: THREAT, INTENDED: THREAT}) @ report_behind()


def rewritten(code: np.ndarray, at: np.ndarray, size: np.ndarray, machines: tuple[Transducer, Transducer]) -> np.ndarray:
    """What the machines, left to right and then right to left, put out for the sentences code[at : at + size], longest first."""
    out = code.copy()
    for machine, place in ((machines[0], lambda m, t: at[:m] + t), (machines[1], lambda m, t: at[:m] + size[:m] - 1 - t)):
        state = np.zeros(len(at), np.int64)
        for t in range(size[0] if len(size) else 0):
            m = np.searchsorted(-size, -t, side="left")  # sentences longer than t
            k = place(m, t)
            c = out[k]
            out[k] = machine.out[state[:m], c]
            state[:m] = machine.to[state[:m], c]
    return out


def word_keys(texts: list[str]) -> Words:
    return Words([t.lower() for t in texts], NO_LETTER, lower=False)


def beginnings(words: Words, which: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of words[which] are longer than size bytes, and their beginnings' hashes."""
    long = words.end[which] - words.start[which] > size
    return long, hashes(words.data, words.start[which][long], words.start[which][long] + size)


@dataclass
class Grammar:
    """Hashes of words, of beginnings (by size) and of pairs of words in order, with their weights; the arcs' weights by
    SCORED; the logistic function of 1, a text's best sentence and the logarithm of 1 + all its sentences."""

    words: tuple[np.ndarray, np.ndarray]
    begin: dict[int, tuple[np.ndarray, np.ndarray]]
    pairs: tuple[np.ndarray, np.ndarray]
    arcs: np.ndarray = field(default_factory=lambda: np.array(list(PRIOR.values())))
    logistic: np.ndarray = field(default_factory=lambda: np.zeros(3))
    machines: tuple[Transducer, Transducer] = (FORWARD, BACKWARD)

    def read(self, words: Words, key: np.ndarray, which: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and weight of each word; which: a place of each distinct word, whose hashes are key; word: which of them each is."""
        symbol, weight = np.zeros(len(which), np.int8), np.zeros(len(which), np.float32)
        for size, table in self.begin.items():
            long, found = beginnings(words, which, size)
            _put(symbol, weight, np.flatnonzero(long), found, table)
        _put(symbol, weight, np.arange(len(which)), key, self.words)
        for s, known in _fixed().items():
            hit = np.isin(key, known)
            symbol[hit], weight[hit] = s, HARM_WEIGHT if s == HARM else 1
        symbol, weight = symbol[word], weight[word]
        doc = words.doc()
        free = np.flatnonzero((symbol[1:] == OTHER) & (doc[1:] == doc[:-1])) + 1  # a pair marks its second word
        _put(symbol, weight, free, pairs_of(key[word])[free - 1], self.pairs)
        return symbol, weight

    def sentences(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each sentence that has an insult or harm: by SCORED the largest weight and the logarithm of 1 + the others, so
        that a long sentence isn't toxic for its length; and its text."""
        words = word_keys(texts)
        key, which, word = np.unique(words.hashes(), return_index=True, return_inverse=True)
        none = np.zeros((0, len(SCORED))), np.zeros(0, np.int64)
        if not len(word):
            return none
        symbol, weight = self.read(words, key, which, word)
        hot = (symbol == INSULT) | (symbol == HARM)
        if not hot.any():
            return none
        ends, commas = np.cumsum(SENTENCE_END[words.data]), np.cumsum(COMMA[words.data])
        sentence = ends[words.start]  # line ends between texts end sentences too
        comma = np.diff(commas[words.start], prepend=0) > 0
        keep = np.isin(sentence, sentence[hot])
        sentence, weight, doc = sentence[keep], weight[keep], words.doc()[keep]
        code = 2 * symbol[keep].astype(np.int64) + comma[keep]
        first = np.flatnonzero(np.diff(sentence, prepend=-1))
        size = np.diff(np.append(first, len(sentence)))
        order = np.argsort(-size, kind="stable")
        put = rewritten(code, first[order], size[order], self.machines) >> 1
        of = np.repeat(np.arange(len(first)), size)
        found = np.stack([_gathered(of[put == s], weight[put == s], len(first)) for s in SCORED], 1)
        return found, doc[first]

    def features(self, texts: list[str]) -> np.ndarray:
        """Per text: its best sentence's score and the logarithm of 1 + all sentences' scores."""
        sums, doc = self.sentences(texts)
        return _features(sums @ self.arcs, doc, len(texts))

    def score(self, texts: list[str]) -> np.ndarray:
        x = self.features(texts)
        return 1 / (1 + np.exp(-np.clip(self.logistic[0] + x @ self.logistic[1:], -30, 30)))


def _put(symbol: np.ndarray, weight: np.ndarray, where: np.ndarray, found: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> None:
    """Marks as insults the places whose hashes the table has."""
    if len(table[0]) and len(where):
        i = np.minimum(np.searchsorted(table[0], found), len(table[0]) - 1)
        hit = table[0][i] == found
        symbol[where[hit]] = INSULT
        weight[where[hit]] = np.maximum(weight[where[hit]], table[1][i[hit]])


def _gathered(of: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    most = np.zeros(n)
    np.maximum.at(most, of, weight)
    return most + np.log1p(np.maximum(0, np.bincount(of, weight, n) - most))


def _features(score: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, 2))
    np.maximum.at(out[:, 0], doc, score)
    out[:, 1] = np.log1p(np.bincount(doc, score, n))
    return out


_FIXED: dict[int, np.ndarray] = {}


def _fixed() -> dict[int, np.ndarray]:
    if not _FIXED:
        for s, text in FIXED.items():
            _FIXED[s] = np.sort(Words([text], NO_LETTER).hashes())
    return _FIXED


def pairs_of(keys: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring words."""
    return mix(keys[:-1] * np.uint64(3) + keys[1:])


def _learn(keys: np.ndarray, docs: np.ndarray, toxic: np.ndarray, words: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Keys that mark toxic texts, by in how many texts of either kind they are. With words, keys are beginnings of them,
    which at least WORDS_OF of the toxic texts' words must have."""
    pairs = np.unique(np.stack([keys, docs.astype(np.uint64)], 1), axis=0)
    known, at = np.unique(pairs[:, 0], return_inverse=True)
    bad = np.bincount(at, toxic[pairs[:, 1].astype(np.int64)], len(known))
    good = np.bincount(at, ~toxic[pairs[:, 1].astype(np.int64)], len(known))
    odds = np.log((bad + 0.5) / (toxic.sum() + 1)) - np.log((good + 0.5) / ((~toxic).sum() + 1))
    take = odds - 1.64 * np.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5)) >= LOG_ODDS
    if words is not None:
        of = np.unique(np.stack([keys, words], 1)[toxic[docs]], axis=0)[:, 0]
        take &= np.searchsorted(of, known, side="right") - np.searchsorted(of, known) >= WORDS_OF
    return known[take], odds[take].astype(np.float32)


def apart(texts: list[str]) -> np.ndarray:
    """One text of each group of like ones, whose least hash of two neighbouring words is the same: else the words that
    copies of one text share would seem to be in many texts."""
    words = word_keys(texts)
    pair = pairs_of(words.hashes())
    least = [pair[a : b - 1].min() if b - a > 1 else np.uint64(0) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
    return np.sort(np.unique(least, return_index=True)[1])


def fit_logistic(x: np.ndarray, bad: np.ndarray, each: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(12):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (each * p * (1 - p) + 1e-9)[:, None]).T @ x + 0.5 * np.eye(x.shape[1]), x.T @ (each * (bad - p)) - 0.5 * w)
    return w


def fit_arcs(grammar: Grammar, texts: list[str], bad: np.ndarray, steps: int = 300, rate: float = 0.02) -> None:
    """Learns the arcs' weights and the logistic function together, by Adam; both kinds of texts weigh the same."""
    sums, doc = grammar.sentences(texts)
    n, each = len(texts), np.where(bad, 0.5 / bad.mean(), 0.5 / (~bad).mean())
    prior = grammar.arcs.copy()
    theta = fit_logistic(np.column_stack([np.ones(n), _features(sums @ prior, doc, n)]), bad, each)
    if len(doc):
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        arcs, m, v = prior.copy(), np.zeros(len(prior)), np.zeros(len(prior))
        for t in range(1, steps + 1):
            score = sums @ arcs
            x = _features(score, doc, n)
            wrong = each * (1 / (1 + np.exp(-np.clip(theta[0] + x @ theta[1:], -30, 30))) - bad) / n
            best = first + np.array([score[a:b].argmax() for a, b in zip(first, np.append(first[1:], len(doc)), strict=True)])
            gradient = theta[1] * wrong[doc[best]] @ sums[best] + theta[2] * (wrong[doc] / (np.expm1(x[doc, 1]) + 1)) @ sums + HOLD * (arcs - prior)
            m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
            arcs = np.maximum(0, arcs - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9))
            if t % 25 == 0:
                theta = fit_logistic(np.column_stack([np.ones(n), _features(sums @ arcs, doc, n)]), bad, each)
        grammar.arcs = arcs
    grammar.logistic = theta


def learn(texts: list[str], toxic: list[bool], machines: tuple[Transducer, Transducer] = (FORWARD, BACKWARD)) -> Grammar:
    """Lexicon, arcs and logistic function. With texts of one kind only, that kind is what every text gets."""
    keep = apart(texts)
    texts, bad = [texts[k] for k in keep], np.array(toxic, bool)[keep]
    none = (np.empty(0, np.uint64), np.empty(0, np.float32))
    if not bad.any() or bad.all():
        return Grammar(none, {}, none, logistic=np.array([5.0 if len(bad) and bad.all() else -5.0, 0, 0]))
    words = word_keys(texts)
    every, key, doc = np.arange(len(words.start)), words.hashes(), words.doc()
    grammar = Grammar(_learn(key, doc, bad), {}, none, machines=machines)
    for size in BEGINNINGS:
        long, found = beginnings(words, every, size)
        grammar.begin[size] = _learn(found, doc[long], bad, key[long])
    # pairs of words that aren't insults on their own, and stand in one text
    plain = grammar.read(words, key, every, every)[0] == OTHER
    both = plain[1:] & plain[:-1] & (doc[1:] == doc[:-1])
    grammar.pairs = _learn(pairs_of(key)[both], doc[1:][both], bad)
    fit_arcs(grammar, texts, bad)
    return grammar


def score_texts(docs: DataFrame, labels: DataFrame, usable: Column, seed: int = 1) -> DataFrame:
    """Per row: doc_id, score (0 to 1), predicted (1 from 0.5 on). Learns from a bounded sample of usable rows of labels.

    Null texts and texts without words are scored as texts that match nothing. Rows of labels whose toxic is null
    are left out; without usable labels every text gets the score of clean ones. Rows of equal doc_id, and repeated rows,
    are scored each by itself; labels of equal hashes are taken by id. Texts are scored whole, however long: a worker holds
    one at a time beside a bounded chunk; a text longer than CHARS isn't learned from unless it is the first of its kind.
    An empty table gives an empty result. Columns other than doc_id, text and toxic aren't read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labels = labels.filter(usable & F.col("toxic").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") == 1).alias("bad"))
    picked = [labels.filter(F.col("bad") == kind).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(TEXTS) for kind in (True, False)]
    picked = labels.sparkSession.createDataFrame(picked[0].unionByName(picked[1]).collect(), "doc_id long, bad boolean")  # at most 2 * TEXTS
    rows = docs.filter(F.col("text").isNotNull()).join(small(picked), "doc_id")
    rows = bounded(rows, "bad", F.xxhash64("doc_id", F.lit(seed)), CHARS).select("text", "bad")
    grammar = broadcast(docs.sparkSession, learned(rows, lambda rows: learn([t for t, _ in rows], [b for _, b in rows])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch.column(1)):
                score = grammar.value.score(texts)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(at, len(texts)), "score": score, "predicted": pa.array((score >= 0.5).astype(np.int32))})

    return docs.mapInArrow(lean(run), "doc_id long, score double, predicted int")
