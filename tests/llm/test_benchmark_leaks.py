"""Latent retrieval of benchmark items: copies, paraphrases, clean texts, edge cases."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from framelake.llm import benchmark_leaks

TOKEN = re.compile(r"[^\W_]+")


def words(text):
    return TOKEN.findall(text.lower())


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ne", "ru") for b in ("ta", "se", "vi", "po") for c in ("x", "n", "r", "l", "sh")]
    say = lambda n: [rng.choice(vocabulary) if rng.random() < .7 else f"u{rng.randrange(5000)}" for _ in range(n)]
    items = [(k, say(rng.randint(12, 50))) for k in range(20)] + [(20, say(150))]
    docs, planted = [], set()
    for d in range(120):
        text = say(rng.randint(5, 400))
        if d % 3 == 0:
            k, item = rng.choice(items)
            copy = item[:]
            for _ in range(len(copy) // 8 if d % 2 else 0):  # paraphrase: changed, left out, added words
                i = rng.randrange(len(copy))
                copy[i:i + 1] = rng.choice([["other"], [], [copy[i], "added"]])
            at = rng.randrange(len(text))
            text[at:at] = copy
            planted.add((d, k))
        docs.append((d, " ".join(text).capitalize()))
    return docs, [(k, " ".join(w)) for k, w in items], planted


@pytest.mark.parametrize("item_parts", [256, 6])
def test_copies_and_paraphrases(spark, item_parts):
    docs, items, planted = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = benchmark_leaks.leaks(frame, bench, item_parts).collect()
    assert {(r.doc_id, r.item_id) for r in got} == planted
    kept = benchmark_leaks.decontaminated(frame, bench, item_parts)
    assert sorted(r.doc_id for r in kept.collect()) == [d for d, _ in docs if d not in {p for p, _ in planted}]


def test_lcs():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b = rng.integers(0, 6, rng.integers(1, 90)), rng.integers(0, 6, rng.integers(0, 90))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert benchmark_leaks.lcs(a, b) == table[-1, -1]


def test_query_finds_every_copy(spark):
    folder = "/root/testdata/sf0.01"
    docs = [(r.doc_id, " ".join(words(r.text))) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    items = [(r.item_id, " ".join(words(r.text))) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in benchmark_leaks.op5_latent_leaks(spark, folder).collect()}
    assert got == {(d, k) for k, item in items for d, text in docs if item in text}


def test_edges(spark):
    item = "seven quick foxes jumped over eleven lazy sleeping hounds yesterday"
    rows = [(None, item.upper(), 1), (1, None, 1), (2, "", 1), (3, "filler text " * 60000 + item + " tail" * 40000, 1), (4, f"so {item}!", 1),
            (4, f"so {item}!", 1), (5, "nothing here", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([("q1", item, 1), ("q2", None, 1), ("q3", "", 1), (None, "", 1)], "item_id string, text string, doc_id int")
    got = benchmark_leaks.leaks(docs, bench).collect()
    assert sorted((str(r.doc_id), r.item_id) for r in got) == [("3", "q1"), ("4", "q1"), ("4", "q1"), ("None", "q1")]
    kept = benchmark_leaks.decontaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 5]
    assert benchmark_leaks.leaks(docs, bench.limit(0)).count() == 0
    assert benchmark_leaks.leaks(docs.limit(0), bench).count() == 0


def test_items_listed_one_after_another(spark):
    """A short item among rarer neighbours fills a small share of a passage and is found all the same."""
    rng = random.Random(5)
    items = [(k, [f"w{rng.randrange(300)}" for _ in range(12)]) for k in range(8)] + [(k, [f"v{k}x{i}" for i in range(48)]) for k in range(8, 16)]
    docs = [(0, [w for pair in zip(items[:8], items[8:], strict=True) for _, item in pair for w in item])]
    docs += [(d, [f"w{rng.randrange(300)}" for _ in range(200)]) for d in range(1, 60)]
    frame = spark.createDataFrame([(d, " ".join(t)) for d, t in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in items], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in benchmark_leaks.leaks(frame, bench).collect()} == {(0, k) for k, _ in items}


@pytest.mark.parametrize("every", [1, 3])
def test_item_held_by_many_rows(spark, every):
    """Nor does it matter how common an item is, or that rarer words stand around it."""
    item = "which of these eleven rivers flows north through two capital cities".split()
    docs = [(d, " ".join([*(f"a{d}x{i}" for i in range(70 * (every > 1))), *(item * (d % every == 0)), *(f"b{d}x{i}" for i in range(70 * (every > 1)))]))
            for d in range(90)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(f"z{i}" for i in range(59)))], "item_id long, text string")
    got = benchmark_leaks.leaks(frame, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(d, 1) for d in range(0, 90, every)}
    assert benchmark_leaks.decontaminated(frame, bench).count() == 90 - len(got)


def test_the_latent_cosine_decides(spark, monkeypatch):
    """Another subject in the same common words is no leak: only the cosine tells it from a copy, whatever stands around them."""
    ask = lambda subject: f"what is the name of the first of all the {subject} that can be seen in the sky of the far north"
    rng = random.Random(8)
    common = ask("").split()
    noise = lambda: [rng.choice(common) if rng.random() < .6 else f"n{rng.randrange(900)}" for _ in range(60)]
    subjects = {0: "aldebaran zubenelgenubi", 1: "harvested pomegranates", 2: "aldebaran zubenelgenubi", 3: "unheard melodies"}
    docs = [(d, " ".join([*noise(), ask(subject), *noise()])) for d, subject in subjects.items()]
    docs += [(d, " ".join(noise())) for d in range(10, 400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(1, ask("aldebaran zubenelgenubi")), (2, " ".join(f"z{i}" for i in range(40)))], "item_id long, text string")
    found = lambda: {(r.doc_id, r.item_id) for r in benchmark_leaks.leaks(frame, bench).collect()}
    assert found() == {(0, 1), (2, 1)}
    assert sorted(r.doc_id for r in benchmark_leaks.decontaminated(frame, bench).collect() if r.doc_id < 10) == [1, 3]
    model = next(benchmark_leaks.item_models(frame, bench))
    texts = pa.array([t for _, t in docs[:4]], pa.large_string())
    assert set(model.leaks(texts)) == {(0, 1), (2, 1)}
    monkeypatch.setattr(model, "cosine", lambda part, window: 1.0)
    assert set(model.leaks(texts)) == {(row, 1) for row in range(4)}


def test_both_ways_to_the_range_finder_agree():
    rng = np.random.default_rng(7)
    terms, block = 40, rng.normal(size=(40, 9)).astype(np.float32)
    gram, direct = benchmark_leaks._Gram(terms), benchmark_leaks._Direct(block)
    dense = []
    for _ in range(5):
        cells = [np.sort(rng.choice(terms, rng.integers(1, 12), replace=False)) for _ in range(20)]
        size = np.array([len(c) for c in cells])
        column, begin = np.concatenate(cells), np.cumsum(size) - size
        value = rng.random(len(column)).astype(np.float32)
        gram(begin, size, column, value)
        direct(begin, size, column, value)
        for b, n in zip(begin, size, strict=True):
            row = np.zeros(terms)
            row[column[b:b + n]] = value[b:b + n]
            dense.append(row)
    a = np.stack(dense)
    want = a.T @ (a @ block)
    assert np.allclose(gram.times(block), want, rtol=1e-4, atol=1e-4) and np.allclose(direct.times(block), want, rtol=1e-4, atol=1e-4)
