"""Operator 5, benchmark decontamination by latent semantic retrieval.

*Passages.* Texts are cut into cells of ``CELL`` words (runs of letters and digits, lower-cased); a passage is ``WINDOW``
neighbouring cells of one text, whatever the items are. Items longer than ``PART`` words are cut into parts.

*Latent space.* The terms are all words of the items, weighed by the square of their idf, which is never 0. One pass counts
in how many cells of the corpus each term stands; a second accumulates Y = A'A * Omega over the unit rows A of all cells, with
Omega a fixed Gaussian block; the item parts are rows of A too, with as much weight as the corpus, so that the space holds them.
This is the randomised range finder of A; from Y alone the leading right singular vectors follow (the Nystrom form of the
randomised SVD for the positive matrix A'A).

*Search.* The third pass gives every passage that can hold a leak a place in the latent space: its runs of words that are as long as
the part, or twice as long, with all their terms; a passage is a candidate if one of them reaches ``COSINE`` with the part. A candidate is
a leak if its longest common subsequence with the part reaches ``LCS_SHARE`` of it, and that with its answer (the last quarter)
``ANSWER_SHARE``; below ``VERBATIM`` it must also share ``MASS_SHARE`` of the part's weight. Which passages can hold a leak is known
beforehand: such a passage holds so many words of the part that one of its rarest is among them, so only cells with one of those words are
looked at, and of their passages those that hold enough words; this bound loses nothing that the subsequences would accept. A run begins
at any word, so neighbouring words, other items among them, do not hide a copy, whose cosine is 1. So paraphrases by changed, added or
left-out words are found, and texts that share an item's wording but not the words that tell it from others are not.

Items are taken in blocks of ``ITEM_PARTS`` parts, so what tasks and driver hold (terms x dimensions) does not grow with
the benchmark; the corpus side is only read. A null or empty item or text matches nothing; an item is searched however
many rows hold it. Repeated rows are judged one by one. An empty table gives no rows, an empty benchmark no leaks; extra columns pass through ``decontaminated``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from framelake.llm import packed_sums
from framelake.llm.shared import read
from framelake.llm.text_blocks import Words, slices

CELL = 32
PART = 64
DIMENSIONS = 256
OVERSAMPLE = 16
#: Cells of a passage: a part and one cell on each side.
WINDOW = 3 + -(-PART // CELL)
COSINE = 0.2
MASS_SHARE = 0.4
LCS_SHARE = 0.6
VERBATIM = 0.8
ANSWER_SHARE = 0.5
ITEM_PARTS = 256
#: Up to so many terms a task of the range finder adds up A'A (four bytes a number) before it meets Omega; either way gives the same Y.
GRAM_TERMS = 6_144
#: Numbers per packed row of the range finder.
BLOCK = 1 << 18
#: Pairs of a cell and an item part that are looked at together.
PAIRS = 1 << 14

_APART = np.ones(256, bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = False
_FILTER_BITS = 20


@dataclass
class _Part:
    item: object
    words: np.ndarray  # hashes in order
    answer: int  # words of the answer, the last ones


class ItemModel:
    """Item parts, their terms, and after fitting their place in the latent space."""

    def __init__(self, items: list[tuple[object, str]]):
        parts = []
        if items:
            words = Words(pc.utf8_lower(pa.array([t for _, t in items], pa.large_string())), _APART)
            for (item, _), a, b in zip(items, words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
                count = max(1, -(-(b - a) // PART))
                size = -(-(b - a) // count)
                parts += [(item, words.hash[k:min(k + size, b)]) for k in range(a, b, max(1, size))]
        self.terms = np.unique(np.concatenate([w for _, w in parts])) if parts else np.zeros(0, np.uint64)
        self.parts = [_Part(item, w, min(len(w), max(3, len(w) // 4))) for item, w in parts]
        # distinct terms of all parts, and how often each stands in its part and in the answer
        own = [np.unique(np.searchsorted(self.terms, p.words), return_inverse=True, return_counts=True) for p in self.parts]
        self.own_first = np.concatenate([[0], np.cumsum([len(t) for t, _, _ in own], dtype=np.int64)])
        self.own_term = np.concatenate([t for t, _, _ in own] or [np.zeros(0, np.int64)])
        self.own_times = np.concatenate([n for _, _, n in own] or [np.zeros(0, np.int64)])
        self.own_answer = np.concatenate([np.bincount(at[-p.answer:], minlength=len(t)) for p, (t, at, _) in zip(self.parts, own, strict=True)]
                                         or [np.zeros(0, np.int64)])
        sizes = [len(p.words) for p in self.parts]
        self.least = np.array([_least(LCS_SHARE, n) for n in sizes])
        self.least_answer = np.array([_least(ANSWER_SHARE, p.answer) for p in self.parts])
        self.verbatim = np.array([_least(VERBATIM, n) for n in sizes])
        self.likely = np.zeros(1 << _FILTER_BITS, bool)
        self.likely[(self.terms >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(word, term) of all words of a slice that are terms."""
        at = np.flatnonzero(self.likely[(words.hash >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        mine = words.hash[at]
        term = np.minimum(np.searchsorted(self.terms, mine), len(self.terms) - 1)
        same = self.terms[term] == mine
        return at[same], term[same]

    @staticmethod
    def cells(words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(first cell of each text, and one behind the last; cell of each word)."""
        counts = words.counts()
        first = np.concatenate([[0], np.cumsum(-(-counts // CELL))])
        owner = words.owner()
        return first, first[owner] + (np.arange(len(words.hash)) - words.first[owner]) // CELL

    def weigh(self, seen: np.ndarray, cells: int) -> None:
        """Sets the terms' weights from the number of cells with each, and the terms by which each part is found."""
        self.weight, self.corpus_cells = np.log1p((cells + 1) / (seen + 0.5)) ** 2, cells
        self.mass = np.add.reduceat(self.weight[self.own_term], self.own_first[:-1])
        by_term: list[list[int]] = [[] for _ in self.terms]
        for j, part in enumerate(self.parts):
            # of n words with m needed, one of any n - m + 1 must be there: the rarest are taken
            ways = []
            for words, least in ((part.words, self.least[j]), (part.words[-part.answer:], self.least_answer[j])):
                term = np.searchsorted(self.terms, words)
                ways.append(np.unique(term[np.argsort(seen[term], kind="stable")[:len(term) - least + 1]]))
            for t in min(ways, key=lambda w: seen[w].sum()).tolist():
                by_term[t].append(j)
        self.sign_first = np.concatenate([[0], np.cumsum([len(x) for x in by_term], dtype=np.int64)])
        self.sign_part = np.array([j for x in by_term for j in x], np.int64)

    def settle(self, y: np.ndarray, omega: np.ndarray) -> None:
        """Right singular vectors from Y = A'A * Omega, and the items' unit vectors among them."""
        items = np.zeros((len(self.parts), len(self.terms)))
        for j, part in enumerate(self.parts):
            np.add.at(items[j], np.searchsorted(self.terms, part.words), self.weight[np.searchsorted(self.terms, part.words)])
        unit = items / np.maximum(np.linalg.norm(items, axis=1, keepdims=True), 1e-12)
        y = y + max(1, self.corpus_cells) / len(items) * (unit.T @ (unit @ omega))
        shift = 1e-9 * (np.linalg.norm(y) + 1e-300)
        y = y + shift * omega
        inner = omega.T @ y
        values, vectors = np.linalg.eigh((inner + inner.T) / 2)
        keep = values > 1e-12 * values.max(initial=0)
        basis = np.linalg.svd(y @ (vectors[:, keep] / np.sqrt(values[keep])), full_matrices=False)[0][:, :DIMENSIONS]
        latent = items @ basis
        self.project = basis.astype(np.float32)
        self.latent = (latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    def held(self, places: np.ndarray, cells: int, part: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
        """Words, answer words and weight of each part that stand in cells ``low`` to ``high``; ``places`` are sorted term * cells + cell."""
        size = self.own_first[part + 1] - self.own_first[part]
        begin = np.cumsum(size) - size
        own = np.arange(size.sum()) + np.repeat(self.own_first[part] - begin, size)
        term = self.own_term[own]
        at = np.searchsorted(places, term * cells + np.repeat(low, size))
        there = np.append(places, np.iinfo(np.int64).max)[at] <= term * cells + np.repeat(high, size)
        return (np.add.reduceat(there * self.own_times[own], begin), np.add.reduceat(there * self.own_answer[own], begin),
                np.add.reduceat(there * self.weight[term], begin))

    def cosine(self, part: int, window: np.ndarray) -> float:
        """Greatest cosine in the latent space between a part and the runs of ``window`` that are as long, or twice as long, all terms counted."""
        at = np.minimum(np.searchsorted(self.terms, window), len(self.terms) - 1)
        placed = (self.weight[at] * (self.terms[at] == window))[:, None] * self.project[at]
        upto = np.concatenate([np.zeros((1, placed.shape[1])), np.cumsum(placed, axis=0)])
        best, size = -1.0, len(self.parts[part].words)
        for n in (min(size, len(window)), min(2 * size, len(window))):
            runs = upto[n:] - upto[:-n]
            best = max(best, float((runs @ self.latent[part] / np.maximum(np.linalg.norm(runs, axis=1), 1e-6)).max()))
        return best

    def leaks(self, texts: pa.Array) -> dict[tuple[int, object], tuple[float, float, float]]:
        """(text, item) -> (cosine, share of the longest common subsequence, share of the answer)."""
        found: dict[tuple[int, object], tuple[float, float, float]] = {}
        words = Words(pc.utf8_lower(texts), _APART)
        at, term = self.hits(words)
        if not len(at):
            return found
        first, cell_of = self.cells(words)
        cells, parts = int(first[-1]), len(self.parts)
        places = np.unique(term * cells + cell_of[at])
        # cells with a word that a part is found by
        times = np.diff(self.sign_first)[places // cells]
        begin = np.cumsum(times) - times
        sign = np.arange(times.sum()) + np.repeat(self.sign_first[places // cells] - begin, times)
        pair = np.unique(np.repeat(places % cells, times) * parts + self.sign_part[sign])
        for k in range(0, len(pair), PAIRS):
            cell, part = pair[k:k + PAIRS] // parts, pair[k:k + PAIRS] % parts
            text = np.searchsorted(first, cell, "right") - 1
            low, high = first[text], first[text + 1] - 1
            enough = self._enough(places, cells, part, np.maximum(low, cell - WINDOW + 1), np.minimum(high, cell + WINDOW - 1))
            cell, part, low, high = cell[enough], part[enough], low[enough], high[enough]
            # passages with the cell; those that reach over an end of the text are moved inside
            start = np.clip(cell[:, None] - np.arange(WINDOW), low[:, None], np.maximum(low, high - WINDOW + 1)[:, None])
            passage = np.unique(start * parts + part[:, None])
            start, part = passage // parts, passage % parts
            text = np.searchsorted(first, start, "right") - 1
            enough = self._enough(places, cells, part, start, np.minimum(first[text + 1], start + WINDOW) - 1)
            for row, a, j in zip(text[enough].tolist(), start[enough].tolist(), part[enough].tolist(), strict=True):
                a = words.first[row] + (a - first[row]) * CELL
                self._judge(found, row, j, words.hash[a:min(words.first[row + 1], a + WINDOW * CELL)])
        return found

    def _enough(self, places: np.ndarray, cells: int, part: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether cells ``low`` to ``high`` hold so much of a part that they can hold a leak."""
        if not len(part):
            return np.zeros(0, bool)
        words, answer, weight = self.held(places, cells, part, low, high)
        return ((words >= self.least[part]) & (answer >= self.least_answer[part])
                & ((words >= self.verbatim[part]) | (weight >= MASS_SHARE * self.mass[part] - 1e-9)))

    def _judge(self, found: dict, row: int, j: int, window: np.ndarray) -> None:
        """Adds a passage to ``found`` if it is a leak of part ``j`` and the best of its text and item."""
        part, cosine = self.parts[j], self.cosine(j, window)
        if cosine < COSINE:
            return
        share = lcs(part.words, window) / len(part.words)
        if share < LCS_SHARE:
            return
        told_answer = lcs(part.words[-part.answer:], window) / part.answer
        if told_answer < ANSWER_SHARE:
            return
        if share < VERBATIM:
            own = self.own_term[self.own_first[j]:self.own_first[j + 1]]
            if self.weight[own[np.isin(self.terms[own], window)]].sum() < MASS_SHARE * self.mass[j] - 1e-9:
                return
        got, key = (cosine, share, told_answer), (row, part.item)
        found[key] = max(found.get(key, got), got, key=lambda g: (g[1], g[0]))


def _least(share: float, n: int) -> int:
    """The least number of ``n`` words that reaches a share."""
    return max(1, int(np.ceil(share * n - 1e-9)))


def lcs(short: np.ndarray, long: np.ndarray) -> int:
    """Length of the longest common subsequence, one machine word (or more) of bits per step."""
    places: dict[int, int] = {}
    for i, w in enumerate(short.tolist()):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(short)) - 1
    row = full
    for w in long.tolist():
        match = row & places.get(w, 0)
        row = ((row + match) | (row - match)) & full
    return len(short) - row.bit_count()


class _Gram:
    """A'A itself, for so few terms that it fits a task: a cell of q terms adds q (q + 1) / 2 numbers to it, not q rows of Omega."""

    def __init__(self, terms: int):
        self.terms, self.sums = terms, np.zeros(terms * terms, np.float32)

    def __call__(self, begin: np.ndarray, size: np.ndarray, column: np.ndarray, value: np.ndarray) -> None:
        """Adds cells: the terms of each are sorted and begin at ``begin``."""
        left = np.repeat(begin + size, size) - np.arange(len(column))  # terms from this one to the cell's last
        first = np.repeat(np.arange(len(column)), left)
        second = first + np.arange(len(first)) - np.repeat(np.cumsum(left) - left, left)
        np.add.at(self.sums, column[first] * self.terms + column[second], value[first] * value[second])

    def times(self, block: np.ndarray) -> np.ndarray:
        half = self.sums.reshape(self.terms, self.terms)
        return (half @ block + half.T @ block - half.diagonal()[:, None] * block).astype(float)


class _Direct:
    """Y = A'A * Omega cell by cell, for any number of terms."""

    def __init__(self, block: np.ndarray):
        self.block, self.y = block, np.zeros(block.shape)

    def __call__(self, begin: np.ndarray, size: np.ndarray, column: np.ndarray, value: np.ndarray) -> None:
        rows = np.add.reduceat(self.block[column] * value[:, None], begin, axis=0)
        order = np.argsort(column, kind="stable")
        column, spread = column[order], np.repeat(np.arange(len(begin)), size)[order]
        starts = np.flatnonzero(np.append(True, column[1:] != column[:-1]))
        self.y[column[starts]] += np.add.reduceat(rows[spread] * value[order][:, None], starts, axis=0)

    def times(self, block: np.ndarray) -> np.ndarray:
        return self.y


def _fit(docs: DataFrame, model: ItemModel) -> None:
    terms = len(model.terms)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(terms + 1, np.int64)
        for batch in batches:
            for _, texts in slices(batch, "text"):
                words = Words(pc.utf8_lower(texts), _APART)
                first, cell = sent.value.cells(words)
                at, term = sent.value.hits(words)
                pair = np.unique(cell[at] * terms + term)
                counts[:terms] += np.bincount(pair % terms, minlength=terms)
                counts[terms] += first[-1]
        yield from packed_sums.packed(counts, "<i8", BLOCK)

    texts = docs.select(F.col("text").cast("string"))
    counts = packed_sums.total(texts.mapInArrow(seen, packed_sums.SCHEMA), terms + 1, "<i8", BLOCK)
    model.weigh(counts[:terms], int(counts[terms]))
    omega = np.random.default_rng(5).normal(size=(terms, DIMENSIONS + OVERSAMPLE)).astype(np.float32)
    weighted = docs.sparkSession.sparkContext.broadcast((model, omega))

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, block = weighted.value
        add = _Gram(terms) if terms <= GRAM_TERMS else _Direct(block)
        for batch in batches:
            for _, texts in slices(batch, "text"):
                words = Words(pc.utf8_lower(texts), _APART)
                _, cell = known.cells(words)
                at, term = known.hits(words)
                if not len(at):
                    continue
                pair, times = np.unique(cell[at] * terms + term, return_counts=True)
                row, column = pair // terms, pair % terms
                value = times * known.weight[column]
                begin = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                norm = np.sqrt(np.add.reduceat(value * value, begin))
                size = np.diff(np.append(begin, len(row)))
                add(begin, size, column, (value / np.repeat(norm, size)).astype(np.float32))
        yield from packed_sums.packed(add.times(block).reshape(-1), "<f8", BLOCK)

    y = packed_sums.total(texts.mapInArrow(ranged, packed_sums.SCHEMA), omega.size, "<f8", BLOCK).reshape(omega.shape)
    model.settle(y, omega)


def item_models(docs: DataFrame, benchmark: DataFrame, item_parts: int = ITEM_PARTS) -> Iterator[ItemModel]:
    """Fitted models of all items, a block of about ``item_parts`` parts at a time."""
    items = (benchmark.select(F.col("item_id"), F.col("text").cast("string")).filter("text IS NOT NULL")
             .withColumn("parts", F.greatest(F.lit(1), F.ceil(F.regexp_count("text", F.lit(r"[\p{L}\p{N}]+")) / PART))))
    total = items.agg(F.sum("parts")).first()[0] or 0
    blocks = max(1, -(-total // item_parts))
    for block in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).select("item_id", "text").collect()
        model = ItemModel(sorted(((r["item_id"], r["text"]) for r in rows), key=str))
        if len(model.terms):
            _fit(docs, model)
            yield model


def leaks(docs: DataFrame, benchmark: DataFrame, item_parts: int = ITEM_PARTS) -> DataFrame:
    """doc_id, item_id, cosine, lcs_share and answer_share of every text that holds an item."""
    spark = docs.sparkSession
    kind = benchmark.schema["item_id"].dataType.simpleString()
    form = f"doc_id long, item_id {kind}, cosine double, lcs_share double, answer_share double"
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = spark.createDataFrame([], form)
    arrow = to_arrow_schema(out.schema)
    for model in item_models(narrow, benchmark, item_parts):
        sent = spark.sparkContext.broadcast(model)

        def rows(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, texts in slices(batch, "text"):
                    got = sent.value.leaks(texts)
                    names = part.column("doc_id").to_pylist()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v, k.type) for v, k in zip([[names[i] for i, _ in got], [item for _, item in got],
                                                              *([g[k] for g in got.values()] for k in range(3))], arrow, strict=True)],
                        schema=arrow)

        out = out.union(narrow.mapInArrow(rows, form))
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, item_parts: int = ITEM_PARTS) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    out = docs
    for model in item_models(docs, benchmark, item_parts):
        sent = docs.sparkSession.sparkContext.broadcast(model)

        def rows(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, texts in slices(batch, "text"):
                    clean = np.ones(part.num_rows, bool)
                    clean[[i for i, _ in sent.value.leaks(texts)]] = False
                    yield part.filter(pa.array(clean))

        out = out.mapInArrow(rows, docs.schema)
    return out


def op5_latent_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in all documents."""
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {"op5_latent_leaks": op5_latent_leaks}
ORACLES: dict[str, str] = {}
