"""Class bigram scores: base score and counts by hand, a proper model, held-out gain."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framelake.llm import class_lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def base(rows):
    held = {d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1 for d, _ in rows}
    count = Counter()
    for d, text in rows:
        if not held[d]:
            count.update([*tokens(text), None])
    n, v = sum(count.values()), len(count)
    out = []
    for d, text in rows:
        mine = [*tokens(text), None]
        out.append((d, held[d], len(mine), sum(count[t] > 0 for t in mine), n,
                    sum(math.log10((count[t] + .5) / (n + .5 * (v + 1))) for t in mine)))
    return out


@pytest.fixture(scope="module")
def scored(spark, small):
    return class_lm.op9_class_lm(spark, small).collect()


def test_base_score(spark, small, scored):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    want = {r[0]: r for r in base(rows)}
    assert len(scored) == len(rows)
    for r in scored:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[1:5]
        assert r.base_score == pytest.approx(w[5], rel=1e-9)


def test_held_out_gain(scored):
    held = [r for r in scored if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lexicon_size_changes_nothing(spark, small, scored, monkeypatch):
    monkeypatch.setattr(class_lm, "LEXICON", 600)
    again = {r.doc_id: r for r in class_lm.op9_class_lm(spark, small).collect()}
    for r in scored:
        assert again[r.doc_id].n_known == r.n_known
        assert again[r.doc_id].base_score == pytest.approx(r.base_score) and again[r.doc_id].score == pytest.approx(r.score)


def test_exchange_finds_two_kinds():
    rng = np.random.default_rng(2)
    n = np.zeros((21, 21))
    for _ in range(4000):  # even units follow odd ones
        a, b = 2 * rng.integers(10), 2 * rng.integers(10) + 1
        n[a, b] += 1
        n[b, 2 * rng.integers(10)] += 1
    of = class_lm.exchange(n, classes=2)
    assert len(set(of[0:20:2])) == 1 and len(set(of[1:20:2])) == 1 and of[0] != of[1] and of[20] == 2


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b a c", "b a", "c c d", ""] * 3)], "doc_id long, text string")
    model, _ = class_lm.fit(docs)
    total = 0.0
    for word in ["a", "b", "c", "d"]:
        (size, known, base_, score), rest = model.score(pa.array([word], pa.large_string()))
        assert not len(rest[0]) and known[0] == 2
        end = model.log_transition[model.of[class_lm._units(class_lm.Words(pa.array([word], pa.large_string())), model.top,
                                                            model.top_unit)[0]], class_lm.CLASSES]
        total += 10 ** (score[0] - end)
    unseen = sum(10 ** (model.log_transition[class_lm.CLASSES, c] + math.log10(.5) - model.log_class[c]) for c in range(class_lm.CLASSES))
    assert total + unseen + 10 ** model.log_transition[class_lm.CLASSES, class_lm.CLASSES] == pytest.approx(1)


def test_edges(spark):
    rows = [(None, "x Y"), (1, None), (2, ""), (3, "y " * 40000), (3, "new"), (4, "x x"), (4, "x x")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int").withColumn(
        "held_out", class_lm.held_back(F.col("doc_id"), 1))
    model, counts = class_lm.fit(docs.filter("NOT held_out"))
    got = class_lm.score_documents(docs, model, counts).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known) for r in got), key=str) == sorted((r[:4] for r in base(rows)), key=str)
    assert all(r.score < 0 for r in got)
    none = docs.limit(0)
    model, counts = class_lm.fit(none)
    assert class_lm.score_documents(none, model, counts).count() == 0


def test_rare_words_have_classes_of_their_own(spark, monkeypatch):
    """Words beyond the frequent ones with one ending but two kinds of neighbours are not forced into one class."""
    rng = np.random.default_rng(4)
    nouns, verbs = [f"n{k}ing" for k in range(40)], [f"v{k}ing" for k in range(40)]
    texts = [" ".join(w for _ in range(30) for w in ("the", rng.choice(nouns), "will", rng.choice(verbs))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    monkeypatch.setattr(class_lm, "FREQUENT", 2)
    _, classed = class_lm.fit(docs)
    of = {r["hash"]: r["class"] for r in classed.collect()}
    assert len(of) == 82

    def classes(names):
        return Counter(of[int(h)] for h in class_lm.Words(pa.array(names, pa.large_string())).hash.view(np.int64))

    mine, others = classes(nouns), classes(verbs)
    # words move at the same time, so a few may meet in a class that was empty before
    assert sum(max(mine[c], others[c]) for c in mine | others) >= 72


def test_logarithms_are_taken_once_for_each_kind(monkeypatch):
    """Words with few kinds of neighbours cost few logarithms, and go where one logarithm a word, class and neighbour puts them."""
    rng = np.random.default_rng(6)
    words, size = 3000, class_lm.CLASSES
    word = np.repeat(np.arange(words), 4)
    context, n = np.tile([3, 9, 70, 99], words) + rng.integers(0, 3, 4 * words), rng.integers(1, 4, 4 * words)
    of, hashes = rng.integers(0, size, words), rng.integers(0, 1 << 62, words).astype(np.uint64)
    table = np.zeros((size, class_lm.CONTEXTS))
    np.add.at(table, (of[word], context), n)
    taken, whole = [], class_lm._xlogx
    monkeypatch.setattr(class_lm, "_xlogx", lambda x: (taken.append(np.size(x)), whole(x))[1])
    got = class_lm._best(hashes, of, np.zeros(words, bool), word, context, n, table)
    assert sum(taken) < len(word) * size / 4
    total = table.reshape(size, 2, -1).sum(axis=2)
    for w in range(0, words, 100):
        mine = word == w
        held, rest, k = table[:, context[mine]].copy(), total.copy(), n[mine]
        held[of[w]] -= k
        rest[of[w]] -= k.sum() / 2
        gain = (whole(held + k) - whole(held)).sum(axis=1) - (whole(rest + k.sum() / 2) - whole(rest)).sum(axis=1)
        assert gain[got[w]] >= gain.max() - 2e-6


def rare_texts(texts=300, words=200):
    """Texts of a few common words between words that occur once or twice."""
    rng = np.random.default_rng(8)
    return [" ".join(w for k in rng.integers(0, 60 * texts, words // 2) for w in (f"c{k % 7}", f"Word{k}x{k % 5}")) for _ in range(texts)]


def test_disk_for_rare_words(spark, monkeypatch):
    """Words and neighbours outside the lexicon cost a few bytes each in shuffles, not a wide row for every pair."""
    monkeypatch.setattr(class_lm, "LEXICON", 16)
    docs = spark.createDataFrame(list(enumerate(rare_texts(3000))), "doc_id long, text string").coalesce(2).withColumn("held_out", F.col("doc_id") % 5 == 1)

    def files():
        found = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(i).getPath(): found.apply(i).length() for i in range(found.size()) if found.apply(i).getPath().endswith(".data")}

    before = files()
    model, classed = class_lm.fit(docs.filter("NOT held_out"))
    assert class_lm.score_documents(docs, model, classed).count() == 3000
    after = files()
    assert sum(n for path, n in after.items() if path not in before) < 36 * 3000 * 200


def test_scores_by_hand_with_words_outside_the_lexicon(spark, monkeypatch):
    """Classes and counts come back from many blocks to the right tokens: scores and transitions against plain loops."""
    monkeypatch.setattr(class_lm, "LEXICON", 16)
    monkeypatch.setattr(class_lm.word_blocks, "BLOCK_WORDS", 64)
    texts = {i: t for i, t in enumerate([*rare_texts(40, 60), "", None, "never seen before", "c1 c2"])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("held_out", F.col("doc_id") % 5 == 1).repartition(3)
    model, classed = class_lm.fit(docs.filter("NOT held_out"))
    known = {r["hash"]: (r["class"], r["n"]) for r in classed.collect()}
    size, end = class_lm.CLASSES + 1, class_lm.CLASSES
    assert model.lexicon.blocks > 8 and len(model.lexicon.hashes) < len(known) / 8

    def read(text):
        words = class_lm.Words(pa.array([text or ""], pa.large_string()))
        ending = model.of[class_lm._suffix(words)]
        return [known.get(h, (int(e), 0)) for h, e in zip(words.hash.view(np.int64).tolist(), ending, strict=True)]

    table = np.zeros((size, size))
    for i, text in texts.items():
        if i % 5 != 1:
            row = [end, *(c for c, _ in read(text)), end]
            for c, d in zip(row[:-1], row[1:], strict=True):
                table[c, d] += 1
    share = (table.sum(axis=0) + 1) / (table.sum() + size)
    step = np.log10((table + class_lm.K * share) / (table.sum(axis=1, keepdims=True) + class_lm.K))
    class_n, class_types = np.zeros(size), np.zeros(size)
    for c, n in known.values():
        class_n[c] += n
        class_types[c] += 1
    for r in class_lm.score_documents(docs, model, classed).collect():
        row = read(texts[r.doc_id])
        classes = [end, *(c for c, _ in row), end]
        want = sum(step[c, d] for c, d in zip(classes[:-1], classes[1:], strict=True))
        want += sum(math.log10((n + .5) / (class_n[c] + .5 * (class_types[c] + 1))) for c, n in row)
        assert r.score == pytest.approx(want, rel=1e-9) and r.n_known == sum(n > 0 for _, n in row) + 1


def test_counts_of_any_size_fit_packed_rows():
    """Counts beyond a byte come back whole, and words go to blocks in the order of their hashes."""
    n = np.array([1, 254, 255, 256, 1 << 40, 3])
    got = list(class_lm.word_blocks.rows([class_lm.word_blocks.batch("n binary, more binary", [class_lm.word_blocks.counts(n)])]))
    assert class_lm.word_blocks.whole(got[0]).tolist() == n.tolist()
    hashes = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    block = class_lm.word_blocks.block_of(hashes, 7)
    assert (np.diff(block) >= 0).all() and set(block.tolist()) == set(range(7))


def test_sums_are_the_same_by_few_tasks(spark):
    rng = np.random.default_rng(3)
    arrays = [rng.integers(0, 9, 1000) for _ in range(5)]
    rows = spark.createDataFrame([(k // 64, a[k:k + 64].astype("<i8").tobytes()) for a in arrays for k in range(0, 1000, 64)],
                                 class_lm.packed_sums.SCHEMA).repartition(4)
    for tasks in (None, 1, 4):
        assert class_lm.packed_sums.total(rows, 1000, "<i8", 64, tasks=tasks).tolist() == sum(arrays).tolist()
