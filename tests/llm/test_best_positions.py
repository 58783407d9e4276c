"""Best Position search against scoring every document."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from framelake.llm import best_positions

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(docs, items, top=50):
    held = [(name, Counter(t), len(t)) for name, text in docs if (t := terms(text))]
    n, total = len(held), sum(size for *_, size in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for name, c, size in held:
            m = 100 - 50 + (50 * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m))
                        for t in set(terms(text)) if t in c)
            if score > 0 and name is not None:
                scores.append((-score, name))
        out += [(item, r + 1, name, -s) for r, (s, name) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=repr)


def run(spark, docs, items, **options):
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, score int, shard int").repartition(3)
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    return sorted(map(tuple, best_positions.search(d, i, **options).collect()), key=repr)


@pytest.mark.parametrize("options", [dict(), dict(shard_rows=20, top=3), dict(block_terms=4), dict(top=1, shard_rows=7, block_terms=1)])
def test_same_as_scoring_all(spark, options):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(40)] + ["Ñu", "naïve", "A1", "x-y"]
    odds = 1 / np.arange(1, 45)
    docs = [(i, " ".join(rng.choice(vocabulary, rng.integers(0, 60), p=odds / odds.sum()))) for i in range(300)]
    docs += [(500 + i, "w1 w2 w3") for i in range(80)]  # ties
    items = [(i, " ".join(rng.choice(vocabulary, 6))) for i in range(12)]
    assert run(spark, docs, items, **options) == brute(docs, items, options.get("top", 50))


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "... --"), (None, "alpha beta"), (4, "Alpha alpha gamma"), (4, "alpha"), (4, "alpha"), (5, "beta " * 200_000), (6, "é b")]
    items = [(1, "alpha beta"), (None, "gamma"), (2, None), (3, ""), (1, "alpha beta"), (4, "nowhere"), (5, "é b ALPHA")]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, [], items) == run(spark, docs, []) == []


def test_only_documents_without_id(spark):
    docs = [(None, "alpha beta")] * 3 + [(7, "alpha")]
    assert run(spark, docs, [(0, "alpha beta")]) == brute(docs, [(0, "alpha beta")])


def test_stops_early_and_sees_ties():
    """Two lists in nearly the same order: the search ends long before the lists do, but not among equal scores."""
    n = 20_000
    docs, names = np.arange(n), np.arange(n)[::-1].copy()
    falling = np.sort(np.random.default_rng(1).integers(1, 10 ** 6, n))[::-1].copy()
    lists = [best_positions.ImpactList(docs, falling), best_positions.ImpactList(docs, falling // 2)]
    got, scores, scored = best_positions.best_positions(lists, names, 10)
    assert got.tolist() == list(range(10)) and scored < n / 50
    flat = [best_positions.ImpactList(docs, np.full(n, 7))]
    got, scores, scored = best_positions.best_positions(flat, names, 10)
    assert names[got].tolist() == list(range(10)) and scored == n


def test_direct_access_moves_best_positions():
    """A list read once from the top is known far down if the other list leads to its documents."""
    docs = np.arange(100)
    one = best_positions.ImpactList(docs, 1000 - docs)
    two = best_positions.ImpactList(docs[:50], 500 - docs[:50])
    _, _, scored = best_positions.best_positions([one, two], docs, 5, step=8)
    assert scored == 8


def test_whole_tables(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted(map(tuple, best_positions.op13_best_positions(spark, small).collect()), key=repr) == brute(docs, items)
