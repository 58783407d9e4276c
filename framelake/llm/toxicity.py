"""Operator 1, toxicity: a weighted finite-state grammar over clauses.

*Symbols.* Words become symbols: insult, threat, target, negation, report, other. Insults are learned from labels:
words and word beginnings that mark toxic texts and not clean ones; the short lists below are the rest. Typographic quotes, dashes,
ellipses and blanks part words and clauses as their ASCII forms do.

*Transducers.* Three small machines read a clause: negation marks what stands in its scope, reported speech marks all
that follows a verb of saying, and target marks insults and threats in a clause that addresses somebody. They
are composed into one table; its outputs (say, insult + target) add the word's weight to a feature.

*Score.* Logistic regression on the features of a text's matched clauses. Its prior prefers asserted and targeted insults;
the labelled texts correct it.

Learning uses at most ``SAMPLE`` labelled rows (the first by a hash of the id) and only bounded tables leave Spark: ``MOST_MARKS`` marks,
chosen from the five times as many candidates that stand in most toxic sample texts. Scoring
is one pass over whole texts. Labels, language, source and id are no inputs of a score. Null and empty texts have
no clauses and get the score of a text without matches. Labels other than 0 and 1 and null ids teach nothing;
without labels the prior and the lists decide. Extra columns of ``docs`` pass through ``keep_clean``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.shared import cut, held_back, read
from framelake.llm.text_blocks import Words, raw, slices, text_hash

SAMPLE = 10_000
#: Word beginnings that may be learned, in bytes; 0 is the whole word.
BEGINNINGS = (0, 4, 5, 6, 7)
#: A learned mark stands in this many toxic sample texts at least, this many of them without another mark.
LEAST_TEXTS, LEAST_NEW = 3, 2
MOST_MARKS = 4_000

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
LISTS = {
    INSULT: "idiot moron stupid loser scum worthless pathetic disgusting trash clown dumb fool jerk".split(),
    THREAT: "kill murder shoot stab strangle hurt töten umbringen tuer matar".split(),
    TARGET: "you your yours yourself he she they him her them people everyone du dich ihr euch er sie tu toi vous il elle tú usted ustedes él ella".split(),
    NEGATION: "not no never nobody nothing without cannot nicht kein keine nie ne pas jamais nunca ni sin".split(),
    REPORT: "said says say called wrote writes claimed quoted according sagte schrieb dit disait dijo".split(),
}
#: Negation reaches this many words.
SCOPE = 3

#: Bytes that are no letters: words here are runs of ASCII letters and of bytes of other alphabets.
_APART = np.ones(256, bool)
_APART[[*range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = False
#: Bytes that end a clause.
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".!?;:,\n|()"]] = True


#: Blocks with punctuation and separators beyond ASCII; those of them that end a clause.
_BLOCKS = (range(0xA0, 0xC0), range(0x2000, 0x2070), range(0x3000, 0x3040), range(0xFF00, 0xFF40))
_STOPS = "\u2026\u2025\u2012\u2013\u2014\u2015\u203c\u2047\u2048\u2049\u00a1\u00bf\u2028\u2029\u3001\u3002\uff01\uff0c\uff0e\uff1a\uff1b\uff1f\uff5c"


def _plain_codes() -> dict[bytes, np.ndarray]:
    """By the bytes before the last one of a character: what its last byte becomes (0: the character stays)."""
    out: dict[bytes, np.ndarray] = {}
    for code in (c for block in _BLOCKS for c in block):
        if unicodedata.category(chr(code))[0] in "PZ" or code in (0x200B, 0x2060):
            *lead, last = chr(code).encode()
            out.setdefault(bytes(lead), np.zeros(256, np.uint8))[last] = ord("." if chr(code) in _STOPS else " ")
    return out


_PLAIN = _plain_codes()


def plain(texts: pa.Array) -> pa.Array:
    """The texts with typographic punctuation and separators as full stops and blanks, byte for byte."""
    data, at = raw(texts)
    data = data.copy()
    for lead, marks in _PLAIN.items():
        place = np.flatnonzero(data[:len(data) - len(lead)] == lead[0])
        for k in range(1, len(lead)):
            place = place[data[place + k] == lead[k]]
        new = marks[data[place + len(lead)]]
        place, new = place[new > 0], new[new > 0]
        data[place] = new
        for k in range(1, len(lead) + 1):
            data[place + k] = 0x20
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data))


@dataclass(frozen=True)
class Transducer:
    """Deterministic: (state, symbol) -> (state, mark); symbols pass through, marks are added to them."""
    states: int
    step: dict[tuple[int, int], tuple[int, int]]

    def move(self, state: int, symbol: int) -> tuple[int, int]:
        return self.step[state, symbol]


NEGATED, REPORTED, TARGETED = 1, 2, 4


def negation(scope: int = SCOPE) -> Transducer:
    """State k: the negation still reaches k words."""
    step = {}
    for state in range(scope + 1):
        for symbol in range(6):
            step[state, symbol] = (scope if symbol == NEGATION else max(0, state - 1), NEGATED if state else 0)
    return Transducer(scope + 1, step)


def reported() -> Transducer:
    """Once something is said, the rest of the clause is what was said."""
    return Transducer(2, {(s, a): (int(s or a == REPORT), REPORTED if s else 0) for s in (0, 1) for a in range(6)})


def targeted() -> Transducer:
    """Once somebody is addressed, the rest of the clause is about them; read backwards for what stands before."""
    return Transducer(2, {(s, a): (int(s or a == TARGET), TARGETED if s else 0) for s in (0, 1) for a in range(6)})


def compose(first: Transducer, second: Transducer) -> Transducer:
    """Both machines read the same clause; their marks add up."""
    step = {}
    for a in range(first.states):
        for b in range(second.states):
            for symbol in range(6):
                (to_a, mark_a), (to_b, mark_b) = first.move(a, symbol), second.move(b, symbol)
                step[a * second.states + b, symbol] = (to_a * second.states + to_b, mark_a | mark_b)
    return Transducer(first.states * second.states, step)


FORWARD = compose(compose(negation(), reported()), targeted())
BACKWARD = targeted()

#: Features: asserted, targeted, negated and reported insults; targeted threats, other threats.
FEATURES = 6
PRIOR = np.array([1.5, 2.0, 0.3, 0.5, 2.0, 0.0])
PRIOR_BIAS = -3.0


def clause_features(symbols: list[int], weights: list[float]) -> np.ndarray:
    """What one clause adds to the features."""
    marks, state = [], 0
    for symbol in symbols:
        state, mark = FORWARD.move(state, symbol)
        marks.append(mark)
    state = 0
    for i in range(len(symbols) - 1, -1, -1):
        state, mark = BACKWARD.move(state, symbols[i])
        marks[i] |= mark
    out = np.zeros(FEATURES)
    for symbol, weight, mark in zip(symbols, weights, marks, strict=True):
        if symbol == INSULT:
            out[2 if mark & NEGATED else 3 if mark & REPORTED else 1 if mark & TARGETED else 0] += weight
        elif symbol == THREAT:
            out[4 if mark == TARGETED else 5] += weight
    return out


@dataclass
class ToxicityModel:
    """Marks by (bytes of the beginning) -> sorted hashes, weights; list words; coefficients. Bounded by MOST_MARKS."""
    marks: dict[int, tuple[np.ndarray, np.ndarray]]
    bias: float = PRIOR_BIAS
    slope: np.ndarray = field(default_factory=PRIOR.copy)

    def __post_init__(self):
        pairs = sorted((text_hash(w), symbol) for symbol, words in LISTS.items() if symbol != INSULT for w in words)
        self.listed = np.array([h for h, _ in pairs], np.uint64)
        self.symbol = np.array([s for _, s in pairs])

    def features(self, texts: pa.Array) -> np.ndarray:
        """Features of each text of a slice."""
        words = Words(plain(pc.utf8_lower(texts)), _APART)
        out = np.zeros((len(words.first) - 1, FEATURES))
        n = len(words.hash)
        if not n:
            return out
        weight = np.zeros(n)
        for size, (hashes, weights) in self.marks.items():
            if len(hashes):
                mine = words.hash if not size else words.prefix_hash(size)
                at = np.minimum(np.searchsorted(hashes, mine), len(hashes) - 1)
                hit = hashes[at] == mine
                if size:
                    hit &= words.end - words.start >= size
                weight = np.maximum(weight, np.where(hit, weights[at], 0))
        at = np.minimum(np.searchsorted(self.listed, words.hash), len(self.listed) - 1)
        symbol = np.where(self.listed[at] == words.hash, self.symbol[at], OTHER)
        symbol[weight > 0] = INSULT
        weight[symbol == THREAT] = 1.0
        hits = np.flatnonzero((symbol == INSULT) | (symbol == THREAT))
        if not len(hits):
            return out
        owner = words.owner()
        breaks = np.concatenate([[0], np.cumsum(_BREAK[words.data])])
        fresh = np.ones(n, bool)
        fresh[1:] = (owner[1:] != owner[:-1]) | (breaks[words.start[1:]] > breaks[words.end[:-1]])
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], n)
        for clause in np.unique(np.searchsorted(first, hits, "right") - 1).tolist():
            a, b = first[clause], last[clause]
            out[owner[a]] += clause_features(symbol[a:b].tolist(), weight[a:b].tolist())
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + np.log1p(features) @ self.slope, -30, 30)))

    def fit(self, features: np.ndarray, toxic: np.ndarray, steps: int = 30) -> None:
        """Logistic regression with a Gaussian prior around the built-in coefficients, by Newton steps."""
        x = np.hstack([np.ones((len(features), 1)), np.log1p(features)])
        prior = np.concatenate([[PRIOR_BIAS], PRIOR])
        inverse = np.diag([0.05] + [0.5] * FEATURES)
        w = prior.copy()
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + inverse, x.T @ (toxic - p) - inverse @ (w - prior))
            w = w + step / max(1.0, np.abs(step).max())
        self.bias, self.slope = float(w[0]), np.maximum(w[1:], 0)


def _sample(docs: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """text and toxic of at most ``size`` labelled training rows; equal texts once."""
    known = (labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("_toxic"))
             .filter(F.col("_id").isNotNull() & F.col("_toxic").isin(0, 1) & ~held_back(F.col("_id"), 0))
             .groupBy("_id").agg(F.max("_toxic").alias("toxic")).orderBy(F.xxhash64("_id"), "_id").limit(size))
    # at most ``size`` rows of twelve bytes
    return (docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))
            .join(F.broadcast(known), "_id").select("text", "toxic").dropDuplicates(["text", "toxic"]))


def _mark_rows(sample: DataFrame) -> DataFrame:
    """size, hash, toxic and text number of every distinct beginning of a sample text, as packed rows."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                words = Words(plain(pc.utf8_lower(texts)), _APART)
                owner = words.owner()
                toxic = part.column("toxic").to_numpy(zero_copy_only=False)
                number = part.column("number").to_numpy()
                for size in BEGINNINGS:
                    mine = words.hash if not size else words.prefix_hash(size)
                    long = words.end - words.start >= max(size, 3)
                    pair = np.unique(np.stack([owner[long].astype(np.uint64), mine[long]]), axis=1) if long.any() else np.zeros((2, 0), np.uint64)
                    who = pair[0].astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(who), size, np.int32)), pa.array(pair[1].view(np.int64)), pa.array(toxic[who].astype(np.int32)),
                         pa.array(number[who])], ["size", "hash", "toxic", "number"])

    return sample.withColumn("number", F.xxhash64("text")).mapInArrow(rows, "size int, hash long, toxic int, number long")


def _learn_marks(sample: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Marks that cover the toxic sample texts and keep away from the clean ones, the most telling first."""
    rows = _mark_rows(sample)
    counts = (rows.groupBy("size", "hash").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"),
                                              F.collect_set(F.when(F.col("toxic") == 1, F.col("number"))).alias("texts"))
              .filter((F.col("a") >= LEAST_TEXTS) & (F.col("b") * 50 <= F.col("a")))
              .orderBy(F.col("a").desc(), "b", "size", "hash").limit(MOST_MARKS * 5)).toArrow()
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    found: dict[int, tuple[list, list]] = {size: ([], []) for size in BEGINNINGS}
    uncovered: set[int] = set().union(*counts.column("texts").to_pylist()) if counts.num_rows else set()
    waiting = list(zip(*(counts.column(c).to_pylist() for c in ("size", "hash", "a", "b", "texts")), strict=True))
    share = lambda n, k: (n + 0.5) / (totals.get(k, 0) + 1)

    def keep(size: int, hashed: int, weight: float) -> None:
        found[size][0].append(hashed)
        found[size][1].append(weight)

    for size, hashed, a, b, texts in waiting:
        new = len(uncovered.intersection(texts))
        weight = float(np.log(share(a, 1) / share(b, 0)))
        if new >= LEAST_NEW and weight > 1:
            uncovered.difference_update(texts)
            keep(size, hashed, weight)
    for word in LISTS[INSULT]:
        keep(0, np.array([text_hash(word)], np.uint64).view(np.int64)[0], 3.0)
    out = {}
    for size, (hashes, weights) in found.items():
        best: dict[int, float] = {}
        for h, w in zip(hashes, weights, strict=True):
            best[int(h)] = max(w, best.get(int(h), 0.0))
        keys = np.array(list(best), np.int64).view(np.uint64)
        order = np.argsort(keys)
        out[size] = (keys[order], np.array(list(best.values()))[order])
    return out


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE) -> ToxicityModel:
    """The model of the labelled rows of ``docs`` that are not held out."""
    sample = cut(_sample(docs, labels, sample_rows))
    model = ToxicityModel(_learn_marks(sample))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(list(model.features(texts)), pa.list_(pa.float64()))],
                                                 ["toxic", "features"])

    got = sample.mapInArrow(features, "toxic int, features array<double>").toArrow()
    if got.num_rows:
        model.fit(np.array(got.column("features").to_pylist()), got.column("toxic").to_numpy().astype(float))
    return model


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score (0 to 1) and features of every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                features = sent.value.features(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sent.value.score(features)), pa.array(list(features), pa.list_(pa.float64()))],
                    ["doc_id", "score", "features"])

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(rows, "doc_id long, score double, features array<double>"))


def keep_clean(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                yield part.filter(pa.array(sent.value.score(sent.value.features(texts)) < 0.5))

    return docs.mapInArrow(rows, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents by a grammar learned from four fifths of the labels."""
    docs = read(spark, sf_dir, "documents")
    model = learn(docs, read(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", held_back(F.col("doc_id"), 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op1_toxicity": op1_toxicity}
ORACLES: dict[str, str] = {}
