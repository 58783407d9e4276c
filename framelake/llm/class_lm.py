"""Operator 9, language-model scoring by Brown class bigrams.

Tokens are words (A-Z lower-cased) and one end per text. The model is P(class | class before) * P(word | class):

* *Seed.* The ``FREQUENT`` most frequent words are units, all others share ``SUFFIXES`` units by a hash of their last three
  bytes. Bigrams of units are counted over all training text and units move one by one to the class that raises the
  likelihood most, until none moves or ``ROUNDS`` rounds are over: a table of fixed size, on the driver.
* *Exchange of all words.* Every word of the training text is then a unit of its own. One pass counts, per word, the seed classes
  before and behind it (a sparse row of the table of words by classes, which grows with the corpus and stays in Spark). In
  ``EXCHANGES`` rounds each word but the frequent ones, which moved already, goes to the class that fits its row best, judged by the
  broadcast class totals without the word; a round that does not raise the likelihood ends them.
  Only words never seen in training have the class of their ending.
* *Smoothing.* A transition is (n(c', c) + K * P(c)) / (n(c') + K); a word is (n(w) + 0.5) / (n(c) + 0.5 * (types(c) + 1)), so
  each class keeps mass for a word it never saw.

Rows of words and of texts are packed (``word_blocks``). Contexts are dealt to blocks of words by hash, and a round writes each block with
its new classes. Texts become sequences of classes once: the ``LEXICON`` commonest words are looked up in the task, the others
ask the block that holds them, and the answers meet the sequence again. Transitions and scores are read from the sequences. No word is hot
there, as the hot ones are in the lexicon.

Null and empty texts are the end token alone; null ids count as empty text for the split. Rows that repeat are
scored one by one. Only ``doc_id`` and ``text`` are read. Without training rows every probability is that of the
smoothing alone; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from framelake.llm import packed_sums, word_blocks
from framelake.llm.shared import cut, held_back, read
from framelake.llm.text_blocks import Words, mix64, slices

FREQUENT = 512
SUFFIXES = 1024
UNITS = FREQUENT + SUFFIXES + 1
END = UNITS - 1
CLASSES = 64
LEXICON = 1 << 18
ROUNDS = 8
EXCHANGES = 3
#: Classes before a word and behind it.
CONTEXTS = 2 * (CLASSES + 1)
K = 8.0
#: Words that a task counts before it sends their counts on.
SEND_WORDS = 1_000_000
#: Counts that a task holds before it folds or sends them.
HELD = 1 << 22
#: Steps of word counts in an octave, and steps in all.
STEPS, ALL_STEPS = 16, 1024
#: Rows of the bigram table in one packed row.
BLOCK = 128


def _suffix(words: Words) -> np.ndarray:
    """Unit of each word by its last bytes."""
    code = np.zeros(len(words.start), np.uint64)
    for k in range(3):
        at = words.end - 1 - k
        inside = at >= words.start
        code = code * np.uint64(256) + np.where(inside, words.data[np.maximum(at, 0)], 0).astype(np.uint64)
    return (FREQUENT + mix64(code) % np.uint64(SUFFIXES)).astype(np.int64)


def _units(words: Words, top: np.ndarray, top_unit: np.ndarray) -> np.ndarray:
    """Unit of each word; ``top`` holds the sorted hashes of the frequent words."""
    unit = _suffix(words)
    if len(top):
        at = np.minimum(np.searchsorted(top, words.hash), len(top) - 1)
        hit = top[at] == words.hash
        unit[hit] = top_unit[at[hit]]
    return unit


def _folded(kept: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, each once, and the sums of their counts."""
    key, n = (np.concatenate(x) for x in zip(*kept, strict=True))
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(n[order], first)


def word_counts(docs: DataFrame) -> DataFrame:
    """hash and n of every distinct word of ``text``."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: list[np.ndarray] = []
        kept: list[tuple[np.ndarray, np.ndarray]] = []

        def fold() -> None:
            kept.append(np.unique(np.concatenate(hashes), return_counts=True))
            hashes.clear()

        def send() -> pa.RecordBatch:
            word, n = _folded(kept)
            kept.clear()
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], ["hash", "n"])

        for batch in batches:
            for _, texts in slices(batch, "text"):
                words = Words(texts).hash
                if len(words):
                    hashes.append(words)
                if sum(map(len, hashes)) >= SEND_WORDS:
                    fold()
                if sum(len(k[0]) for k in kept) >= HELD:
                    yield send()
        if hashes:
            fold()
        if kept:
            yield send()

    return (docs.select(F.col("text").cast("string")).mapInArrow(rows, "hash long, n long")
            .groupBy("hash").agg(F.sum("n").alias("n")))


def _tokens(words: Words, unit: np.ndarray) -> np.ndarray:
    """Units of all words with an end behind each text."""
    return np.insert(unit, words.first[1:], END)


def unit_bigrams(docs: DataFrame, top: np.ndarray, top_unit: np.ndarray) -> np.ndarray:
    """Counts of neighbouring units (before, after) over all texts; a text begins after an end."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(UNITS * UNITS, np.int64)
        kept: list[np.ndarray] = []
        for batch in batches:
            for _, texts in slices(batch, "text"):
                words = Words(texts)
                token = _tokens(words, _units(words, top, top_unit))
                kept.append(np.concatenate([[END], token[:-1]]) * UNITS + token)
                if sum(map(len, kept)) >= SEND_WORDS:
                    table += np.bincount(np.concatenate(kept), minlength=UNITS * UNITS)
                    kept.clear()
        if kept:
            table += np.bincount(np.concatenate(kept), minlength=UNITS * UNITS)
        yield from packed_sums.packed(table, "<i8", BLOCK * UNITS)

    rows = docs.select("text").mapInArrow(count, packed_sums.SCHEMA)
    return packed_sums.total(rows, UNITS * UNITS, "<i8", BLOCK * UNITS, tasks=4).reshape(UNITS, UNITS)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each unit; the last unit, the end, is a class of its own.

    The commonest units begin a class each, the others wait in one and are placed in the first round. The likelihood is sum n(c, d) log n(c, d) - sum n(c, .) log n(c, .) - sum n(., c) log n(., c).
    """
    units = len(bigrams)
    n = bigrams.astype(np.float64)
    weight = n.sum(axis=1) + n.sum(axis=0)
    order = np.argsort(-weight[:-1], kind="stable")
    order = order[weight[order] > 0]
    waiting, size = classes + 1, classes + 2
    of = np.full(units, waiting)
    of[order[:classes]] = np.arange(min(classes, len(order)))
    of[-1] = classes
    member = np.zeros((units, size))
    member[np.arange(units), of] = 1
    table = member.T @ n @ member
    for _ in range(rounds):
        moved = 0
        for u in order.tolist():
            old = of[u]
            after = np.bincount(of, weights=n[u], minlength=size)
            before = np.bincount(of, weights=n[:, u], minlength=size)
            own = n[u, u]
            after[old] -= own
            before[old] -= own
            table[old, :] -= after
            table[:, old] -= before
            table[old, old] -= own
            logged = _xlogx(table)
            # totals count the unit's neighbours wherever it goes
            rows, cols = table.sum(axis=1) + before, table.sum(axis=0) + after
            gain = (_xlogx(table + after) - logged).sum(axis=1) + (_xlogx(table + before[:, None]) - logged).sum(axis=0)
            at = np.arange(size)
            same = table[at, at]
            gain += (_xlogx(same + after + before + own) - _xlogx(same + after) - _xlogx(same + before) + _xlogx(same))
            gain -= _xlogx(rows + after.sum() + own) - _xlogx(rows) + _xlogx(cols + before.sum() + own) - _xlogx(cols)
            new = int(np.argmax(gain[:classes]))
            if old != waiting and gain[new] <= gain[old] + 1e-6:
                new = old
            table[new, :] += after
            table[:, new] += before
            table[new, new] += own
            of[u] = new
            moved += new != old
        if not moved:
            break
    of[of == waiting] = 0  # units that never occur
    return of


_CONTEXT = "block int, hash binary, class binary, pairs binary, context binary, n binary, more binary"


def _blocks(word: np.ndarray, of: np.ndarray, pair: np.ndarray, n: np.ndarray, blocks: int) -> pa.RecordBatch:
    """Packed rows of words (sorted hashes), their classes, and the counts of pairs (place of the word * CONTEXTS + context, sorted)."""
    owner, context = pair // CONTEXTS, pair % CONTEXTS
    size = np.bincount(owner, minlength=len(word))
    at = np.concatenate([[0], np.cumsum(size)])
    return word_blocks.batch(_CONTEXT, [
        {"block": block, "hash": word[a:b], "class": of[a:b], "pairs": size[a:b], "context": context[at[a]:at[b]],
         **word_blocks.counts(n[at[a]:at[b]])} for block, a, b in word_blocks.edges(word_blocks.block_of(word, blocks))])


def _pairs(row: dict) -> np.ndarray:
    return np.repeat(np.arange(len(row["hash"])), row["pairs"]) * CONTEXTS + row["context"]


def _merged(kept: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Words, classes, pairs and counts of several such sets as one."""
    word, first, place = np.unique(np.concatenate([k[0] for k in kept]), return_index=True, return_inverse=True)
    begin = np.cumsum([0, *(len(k[0]) for k in kept)])
    pair, n = _folded([(place[k[2] // CONTEXTS + a] * CONTEXTS + k[2] % CONTEXTS, k[3]) for k, a in zip(kept, begin[:-1].tolist(), strict=True)])
    return word, np.concatenate([k[1] for k in kept])[first], pair, n


def word_contexts(docs: DataFrame, top: np.ndarray, top_unit: np.ndarray, of: np.ndarray, blocks: int) -> DataFrame:
    """Packed rows, one for each block of words: hashes, seed classes, and how often each seed class stands before a word (0..) and behind it (CLASSES + 1..)."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []

        def send() -> pa.RecordBatch:
            hashes, seed, before, after = (np.concatenate(x) for x in zip(*kept, strict=True))
            kept.clear()
            word, where, at = np.unique(hashes, return_index=True, return_inverse=True)
            pair, n = np.unique(np.concatenate([at * CONTEXTS + before, at * CONTEXTS + CLASSES + 1 + after]), return_counts=True)
            return _blocks(word, seed[where], pair, n, blocks)

        for batch in batches:
            for _, texts in slices(batch, "text"):
                words = Words(texts)
                unit = _units(words, top, top_unit)
                token = of[_tokens(words, unit)]
                at = np.arange(len(unit)) + words.owner()
                if len(unit):
                    kept.append((words.hash, of[unit], np.concatenate([[CLASSES], token[:-1]])[at], token[at + 1]))
                if sum(len(k[0]) for k in kept) >= SEND_WORDS:
                    yield send()
        if kept:
            yield send()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, kept, limit = None, [], HELD
        for row in word_blocks.rows(batches):
            if row["block"] != number and kept:
                yield _blocks(*_merged(kept), blocks)
                kept, limit = [], HELD
            number = row["block"]
            kept.append((row["hash"], row["class"], _pairs(row), word_blocks.whole(row)))
            if sum(len(k[2]) for k in kept) > limit:
                kept = [_merged(kept)]
                limit = max(HELD, 2 * len(kept[0][2]))
        if kept:
            yield _blocks(*_merged(kept), blocks)

    sent = docs.select(F.col("text").cast("string")).mapInArrow(rows, _CONTEXT)
    return word_blocks.dealt(sent, "block").mapInArrow(merge, _CONTEXT)


def _best(hashes: np.ndarray, of: np.ndarray, fixed: np.ndarray, word: np.ndarray, context: np.ndarray, n: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class that fits each word best, given the counts of classes by contexts with the words in their classes ``of``.

    Words move at the same time: where classes fit as well as each other, empty ones above all, each word has an order of its own.
    """
    out, total = of.copy(), table.reshape(CLASSES, 2, -1).sum(axis=2)
    first = np.searchsorted(word, np.arange(len(of) + 1))
    for a in range(0, len(of), 4096):
        b = min(len(of), a + 4096)
        mine = slice(first[a], first[b])
        whose, k, old, at = word[mine] - a, n[mine].astype(np.float64), of[a:b], np.arange(b - a)
        begin = first[a:b] - first[a]
        # logarithms are taken once for each kind of pair and each size: most words share a few
        kind, which = np.unique(n[mine] * CONTEXTS + context[mine], return_inverse=True)
        held = table[:, kind % CONTEXTS].T
        kinds = _xlogx(held + (kind // CONTEXTS)[:, None]) - _xlogx(held)
        own = table[old[whose], context[mine]]
        stays = np.add.reduceat(_xlogx(own) - _xlogx(own - k), begin)
        gain, until = np.empty((b - a, CLASSES)), first[a:b + 1] - first[a]
        for c in range(0, b - a, 128):  # few enough to stay in the cache
            d = min(b - a, c + 128)
            gain[c:d] = np.add.reduceat(kinds.take(which[until[c]:until[d]], axis=0), begin[c:d] - begin[c])
        gain[at, old] = stays
        size = np.add.reduceat(k, begin) / 2  # as many neighbours before as behind
        sizes, which = np.unique(size, return_inverse=True)
        for side in (0, 1):
            rest = total[:, side]
            each = (_xlogx(rest + sizes[:, None]) - _xlogx(rest))[which]
            each[at, old] = _xlogx(rest[old]) - _xlogx(rest[old] - size)
            gain -= each
        fits = gain >= gain.max(axis=1, keepdims=True) - 1e-6
        new, tied = fits.argmax(axis=1), np.flatnonzero(fits.sum(axis=1) > 1)
        order = mix64(hashes[a:b][tied, None] + np.arange(1, CLASSES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(1)
        new[tied] = np.where(fits[tied], order.astype(np.int64), -1).argmax(axis=1)
        out[a:b] = np.where(fixed[a:b] | (gain[at, new] <= gain[at, old] + 1e-6), old, new)
    return out


def exchange_words(contexts: DataFrame, top: np.ndarray, blocks: int) -> DataFrame:
    """The rows of ``word_contexts`` with the classes after the exchange of all words."""
    def moved(table: np.ndarray) -> DataFrame:
        def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in word_blocks.rows(batches):
                pair, n = _pairs(row), word_blocks.whole(row)
                of = _best(row["hash"], row["class"].astype(np.int64), np.isin(row["hash"], top), pair // CONTEXTS, pair % CONTEXTS, n, table)
                yield _blocks(row["hash"], of, pair, n, blocks)

        return cut(now.mapInArrow(move, _CONTEXT))

    def totals(frame: DataFrame) -> np.ndarray:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = np.zeros(CLASSES * CONTEXTS, np.int64)
            for row in word_blocks.rows(batches):
                at = np.repeat(row["class"].astype(np.int64), row["pairs"]) * CONTEXTS + row["context"]
                # sums stay below 2**53, where doubles are exact
                table += np.bincount(at, weights=word_blocks.whole(row), minlength=len(table)).astype(np.int64)
            yield from packed_sums.packed(table, "<i8", CLASSES * CONTEXTS)

        rows = frame.mapInArrow(count, packed_sums.SCHEMA)
        return packed_sums.total(rows, CLASSES * CONTEXTS, "<i8", CLASSES * CONTEXTS, tasks=1).reshape(CLASSES, CONTEXTS).astype(np.float64)

    def likelihood(table: np.ndarray) -> float:
        return _xlogx(table).sum() - _xlogx(table.reshape(CLASSES, 2, -1).sum(axis=2)).sum()

    now = contexts
    table = totals(now)
    for _ in range(EXCHANGES):
        then = moved(table)
        after = totals(then)
        if likelihood(after) <= likelihood(table):
            break
        now, table = then, after
    return now


def _word_rows(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, classes, counts) of the words of a packed row."""
    pair, n = _pairs(row), word_blocks.whole(row)
    before = np.where(pair % CONTEXTS <= CLASSES, n, 0)
    return row["hash"], row["class"].astype(np.int64), np.bincount(pair // CONTEXTS, weights=before, minlength=len(row["hash"])).astype(np.int64)


def _step(n: np.ndarray) -> np.ndarray:
    return np.minimum((STEPS * np.log2(n)).astype(np.int64), ALL_STEPS - 1)


def class_sizes(words: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words counted, distinct words of each class, and distinct words of each step of counts."""
    cuts = [CLASSES, 2 * CLASSES]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(2 * CLASSES + ALL_STEPS, np.int64)
        for row in word_blocks.rows(batches):
            _, of, n = _word_rows(row)
            sums += np.concatenate([np.bincount(of, weights=n, minlength=CLASSES).astype(np.int64), np.bincount(of, minlength=CLASSES),
                                    np.bincount(_step(n), minlength=ALL_STEPS)])
        yield from packed_sums.packed(sums, "<i8", len(sums))

    size = 2 * CLASSES + ALL_STEPS
    return tuple(np.split(packed_sums.total(words.mapInArrow(count, packed_sums.SCHEMA), size, "<i8", size, tasks=1), cuts))


def common_words(words: DataFrame, steps: np.ndarray) -> pa.Table:
    """hash, class and n of the ``LEXICON`` commonest words: whole steps of counts, and of the next step a range of hashes.

    The words are picked where they are, so that no task holds those of all others.
    """
    behind = np.concatenate([np.cumsum(steps[::-1])[::-1], [0]])
    least = int(np.argmax(behind <= LEXICON))
    share = (LEXICON - behind[least]) / max(1, steps[least - 1]) if least else 0.0
    below = np.uint64(min(int(share * 2.0 ** 64), (1 << 64) - 1))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in word_blocks.rows(batches):
            hashes, of, n = _word_rows(row)
            step = _step(n)
            held = (step >= least) | ((step == least - 1) & (mix64(hashes) < below))
            yield pa.RecordBatch.from_arrays([pa.array(hashes[held].view(np.int64)), pa.array(of[held].astype(np.int32)), pa.array(n[held])],
                                             ["hash", "class", "n"])

    return words.mapInArrow(pick, "hash long, class int, n long").toArrow()


def word_rows(words: DataFrame) -> DataFrame:
    """hash, class and n of every word."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in word_blocks.rows(batches):
            hashes, of, n = _word_rows(row)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(of.astype(np.int32)), pa.array(n)], ["hash", "class", "n"])

    return words.mapInArrow(rows, "hash long, class int, n long")


#: Set in a token whose class waits for an answer.
RARE = 128


class Lexicon:
    """The commonest words with count and class, the sizes of classes, and the classes of endings for words never seen. Its size is fixed by the constants."""

    def __init__(self, common: pa.Table, class_n: np.ndarray, class_types: np.ndarray, texts: int, top: np.ndarray, top_unit: np.ndarray,
                 of: np.ndarray, blocks: int):
        hashes = common.column("hash").to_numpy().view(np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.classes = hashes[order], common.column("class").to_numpy()[order].astype(np.uint8)
        self.top, self.top_unit, self.of, self.texts, self.blocks = top, top_unit, of, texts, blocks
        self.tokens, self.types = int(class_n.sum()) + texts, int(class_types.sum()) + (texts > 0)
        self.log_base = np.log10(self.tokens + 0.5 * (self.types + 1))
        self.log_class = np.log10(np.append(class_n, 0) + 0.5 * (np.append(class_types, 0) + 1))
        self.log_n = np.log10(common.column("n").to_numpy()[order] + 0.5)

    def read(self, words: Words) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Columns of texts: ``token`` (classes with ends, RARE set outside the lexicon), and by text ``size`` (tokens), ``known``, ``base``, ``emitted``
        without what words outside the lexicon add; and the hashes of those words."""
        texts, owner = len(words.first) - 1, words.owner()
        hit, at = np.zeros(len(words.hash), bool), np.zeros(len(words.hash), np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, words.hash), len(self.hashes) - 1)
            hit = self.hashes[at] == words.hash
        token = (self.of[_suffix(words)] | RARE).astype(np.uint8)
        known = np.full(texts, int(self.texts > 0), np.int64)
        base = (words.counts() + 1) * -self.log_base + np.log10(self.texts + 0.5)
        emitted = np.zeros(texts)
        if hit.any():
            at, mine = at[hit], owner[hit]
            token[hit] = self.classes[at]
            known += np.bincount(mine, minlength=texts)
            seen = np.bincount(mine, weights=self.log_n[at], minlength=texts)
            base += seen
            emitted += seen - np.bincount(mine, weights=self.log_class[self.classes[at]], minlength=texts)
        return {"token": np.insert(token, words.first[1:], CLASSES), "size": words.counts() + 1, "known": known, "base": base,
                "emitted": emitted}, words.hash[~hit]

    def answered(self, row: dict, of: np.ndarray, n: np.ndarray) -> dict:
        """The columns of ``read`` with the classes (255: never seen) and counts of the words outside the lexicon."""
        token = row["token"].copy()
        at = np.flatnonzero(token >= RARE)
        token[at] = np.where(of == 255, token[at] - RARE, of)
        owner, texts = np.repeat(np.arange(len(row["size"])), row["size"])[at], len(row["size"])
        seen = np.bincount(owner, weights=np.log10(n + 0.5), minlength=texts)
        return row | {"token": token, "known": row["known"] + np.bincount(owner, weights=n > 0, minlength=texts).astype(np.int64),
                      "base": row["base"] + seen,
                      "emitted": row["emitted"] + seen - np.bincount(owner, weights=self.log_class[token[at]], minlength=texts)}


_TEXTS = "token binary, size binary, doc_id binary, marks binary, known binary, base binary, emitted binary"
_DEALT = f"deal long, kind int, parcel long, hash binary, class binary, n binary, more binary, rare binary, {_TEXTS}"
#: Kinds of rows where words are looked up, in order: the words of a block, what is asked of it, texts that pass by.
HOLDS, ASKS, PASSES = 0, 1, 2
#: Marks of a text.
HELD_OUT, NO_ID = 1, 2


def sequences(docs: DataFrame, lexicon: Lexicon, classed: DataFrame) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, held_out) as a sequence of classes, in packed rows of some SEND_WORDS words."""
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)
    blocks = lexicon.blocks

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parcel = TaskContext.get().partitionId() << 32
        kept: list[tuple[dict, np.ndarray]] = []

        def send() -> pa.RecordBatch:
            row = {name: np.concatenate([k[0][name] for k in kept]) for name in kept[0][0]}
            hashes = np.concatenate([k[1] for k in kept])
            kept.clear()
            block = word_blocks.block_of(hashes, blocks)
            order = np.argsort(block, kind="stable")
            return word_blocks.batch(_DEALT, [row | {"deal": -1 - parcel, "kind": PASSES, "parcel": parcel, "rare": block}, *(
                {"deal": b, "kind": ASKS, "parcel": parcel, "hash": hashes[order[first:end]]} for b, first, end in word_blocks.edges(block[order]))])

        for batch in batches:
            for part, texts in slices(batch, "text"):
                got, hashes = sent.value.read(Words(texts))
                ids, held = part.column("doc_id"), part.column("held_out")
                got["doc_id"] = ids.fill_null(0).to_numpy()
                got["marks"] = held.to_numpy(zero_copy_only=False) * HELD_OUT + ids.is_null().to_numpy(zero_copy_only=False) * NO_ID
                kept.append((got, hashes))
                if sum(len(k[0]["token"]) for k in kept) >= SEND_WORDS:
                    yield send()
                    parcel += 1
        if kept:
            yield send()

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column("hash").to_numpy().view(np.uint64)
            block = word_blocks.block_of(hashes, blocks)
            order = np.argsort(block, kind="stable")
            of, n = batch.column("class").to_numpy(), batch.column("n").to_numpy()
            yield word_blocks.batch(_DEALT, [
                {"deal": b, "kind": HOLDS, "hash": hashes[mine], "class": of[mine], **word_blocks.counts(n[mine])}
                for b, first, end in word_blocks.edges(block[order]) for mine in [order[first:end]]])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, table, held = None, None, []
        for row in word_blocks.rows(batches):
            if row["deal"] != number:
                number, table, held = row["deal"], None, []
            if row["kind"] == HOLDS:
                held.append((row["hash"], row["class"], word_blocks.whole(row)))
            elif row["kind"] == PASSES:
                yield word_blocks.batch(_DEALT, [row])
            else:
                if table is None and held:
                    table = [np.concatenate(x) for x in zip(*held, strict=True)]
                    order = np.argsort(table[0])
                    table = [x[order] for x in table]
                of, n = np.full(len(row["hash"]), 255, np.uint8), np.zeros(len(row["hash"]), np.int64)
                if table is not None:
                    at = np.minimum(np.searchsorted(table[0], row["hash"]), len(table[0]) - 1)
                    hit = table[0][at] == row["hash"]
                    of[hit], n[hit] = table[1][at[hit]], table[2][at[hit]]
                yield word_blocks.batch(_DEALT, [{"deal": number, "kind": ASKS, "parcel": row["parcel"], "class": of, **word_blocks.counts(n)}])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = None
        for row in word_blocks.rows(batches):  # the texts of a parcel are its first row
            if row["kind"] == PASSES:
                if texts is not None:
                    yield word_blocks.batch(_TEXTS, [sent.value.answered(texts, of, n)])
                texts = row
                of, n = np.full(len(row["rare"]), 255, np.uint8), np.zeros(len(row["rare"]), np.int64)
                order = np.argsort(row["rare"], kind="stable")
                block = row["rare"][order]
            else:
                mine = order[np.searchsorted(block, row["deal"]):np.searchsorted(block, row["deal"], "right")]
                of[mine], n[mine] = row["class"], word_blocks.whole(row)
        if texts is not None:
            yield word_blocks.batch(_TEXTS, [sent.value.answered(texts, of, n)])

    asked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), "held_out").mapInArrow(ask, _DEALT)
    found = word_blocks.dealt(asked.unionByName(classed.mapInArrow(hold, _DEALT)), "deal", "kind").mapInArrow(answer, _DEALT)
    return word_blocks.dealt(found, "parcel", "deal").mapInArrow(meet, _TEXTS)


def _before(token: np.ndarray) -> np.ndarray:
    """The class before each token; a text begins after an end."""
    return np.concatenate([[CLASSES], token[:-1]])


def class_bigrams(texts: DataFrame) -> np.ndarray:
    """Counts of neighbouring classes over all texts that are not held out."""
    size = CLASSES + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size * size, np.int64)
        for row in word_blocks.rows(batches):
            token = row["token"][np.repeat(row["marks"] & HELD_OUT == 0, row["size"])].astype(np.int64)
            if len(token):
                table += np.bincount(_before(token) * size + token, minlength=size * size)
        yield from packed_sums.packed(table, "<i8", size * size)

    rows = texts.mapInArrow(count, packed_sums.SCHEMA)
    return packed_sums.total(rows, size * size, "<i8", size * size, tasks=1).reshape(size, size).astype(np.float64)


def _total(log_transition: np.ndarray, token: np.ndarray, size: np.ndarray, emitted: np.ndarray) -> np.ndarray:
    """Score of each text by its classes and what its words emit."""
    token = token.astype(np.int64)
    return emitted + np.bincount(np.repeat(np.arange(len(size)), size), weights=log_transition[_before(token), token], minlength=len(size))


class ClassModel:
    """What scoring needs: lexicon, classes and transitions."""

    def __init__(self, lexicon: Lexicon, table: np.ndarray):
        self.lexicon, self.top, self.top_unit, self.of = lexicon, lexicon.top, lexicon.top_unit, lexicon.of
        self.tokens, self.log_class = lexicon.tokens, lexicon.log_class
        share = (table.sum(axis=0) + 1) / (table.sum() + CLASSES + 1)
        self.log_transition = np.log10((table + K * share) / (table.sum(axis=1, keepdims=True) + K))

    def score(self, texts: pa.Array) -> tuple[list[np.ndarray], tuple[np.ndarray, ...]]:
        """Per text (tokens, known, base, score) without what words outside the lexicon add but their endings' steps, and the hashes of these words."""
        got, rest = self.lexicon.read(Words(texts))
        return [got["size"], got["known"], got["base"], _total(self.log_transition, got["token"] & (RARE - 1), got["size"], got["emitted"])], (rest,)


def learn(train: DataFrame) -> tuple[Lexicon, DataFrame]:
    """Lexicon of the texts of ``train``, and hash, class and n of all its words."""
    texts, seen = train.count(), Observation()
    common = word_counts(train).observe(seen, F.count(F.lit(1)).alias("types")).orderBy(F.col("n").desc(), "hash").limit(FREQUENT).collect()
    blocks = max(1, -(-(seen.get["types"] or 0) // word_blocks.BLOCK_WORDS))
    top = np.sort(np.array([row["hash"] for row in common], np.int64).view(np.uint64))
    top_unit = np.arange(len(top))
    of = exchange(unit_bigrams(train, top, top_unit))
    words = exchange_words(cut(word_contexts(train, top, top_unit, of, blocks)), top, blocks)
    class_n, class_types, steps = class_sizes(words)
    return Lexicon(common_words(words, steps), class_n, class_types, texts, top, top_unit, of, blocks), word_rows(words)


def fit(train: DataFrame) -> tuple[ClassModel, DataFrame]:
    """The model of the texts of ``train``, and hash, class and n of all its words."""
    lexicon, classed = learn(train)
    texts = sequences(train.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(False).alias("held_out")), lexicon, classed)
    return ClassModel(lexicon, class_bigrams(texts)), classed


def scores(texts: DataFrame, model: ClassModel) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score and score of the texts of ``sequences``."""
    sent = texts.sparkSession.sparkContext.broadcast(model.log_transition)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in word_blocks.rows(batches):
            yield pa.RecordBatch.from_arrays([
                pa.array(row["doc_id"], mask=row["marks"] & NO_ID > 0), pa.array(row["marks"] & HELD_OUT > 0), pa.array(row["size"].astype(np.int64)),
                pa.array(row["known"]), pa.array(row["base"]), pa.array(_total(sent.value, row["token"], row["size"], row["emitted"]))],
                ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return texts.mapInArrow(rows, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def score_documents(docs: DataFrame, model: ClassModel, classed: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score and score of every row of ``docs`` (doc_id, text, held_out)."""
    return scores(sequences(docs, model.lexicon, classed), model)


def op9_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of four fifths of them."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", held_back(F.col("doc_id"), 1).alias("held_out"))
    lexicon, classed = learn(docs.filter(~F.col("held_out")))
    texts = cut(sequences(docs, lexicon, classed))  # read twice: for the transitions and for the scores
    model = ClassModel(lexicon, class_bigrams(texts))
    return scores(texts, model).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


QUERIES = {"op9_class_lm": op9_class_lm}
ORACLES: dict[str, str] = {}
