"""Phrase mining by prefix-free parsing against plain counting."""

import re
from collections import Counter

import numpy as np
import pytest

from framelake.llm import phrase_mining

LOWER = {c: c + 32 for c in range(65, 91)}


def pieces(text):
    return [re.findall("[^ \t]+", p) for p in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER))]


def brute(rows, least, top):
    counts, sizes = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            sizes[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i:i + k])] += 1
    out = []
    for lang, found in counts.items():
        often = {p: f for p, f in found.items() if f >= least}
        kept = []
        for p, a in often.items():
            if len(p) == 1:
                continue
            score, _, l, r = min((2000000 * a // (found[p[:k]] + found[p[k:]]), k, found[p[:k]], found[p[k:]]) for k in range(1, len(p)))
            longer = [f for q, f in often.items() if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if all(100 * f < 80 * a for f in longer):
                kept.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, sizes[lang], -score))
    return sorted(out)


def mined(frame, **options):
    return sorted(map(tuple, phrase_mining.mine(frame, **options).collect()))


@pytest.mark.parametrize("options", [dict(period=1), dict(period=4, longest=8), dict(period=10 ** 9), dict(period=10 ** 9, longest=1)])
def test_chunks_hold_every_run_once(spark, options):
    rng = np.random.default_rng(5)
    vocabulary = ["the", "Of", "ñandú", "x", "data.", "set,", "a", "b\tb", "line\nfeed", "9"]
    rows = [(" ".join(rng.choice(vocabulary, rng.integers(0, 120))), ["en", "EN", None, "und", ""][i % 5]) for i in range(200)]
    rows += [("one fixed sentence that many texts share word for word. " * 3, "en")] * 90
    frame = spark.createDataFrame([(*r, 1, "z") for r in rows], "text string, lang string, rank int, phrase string").repartition(5)
    assert mined(frame, least=5, top=40, **options) == brute(rows, 5, 40)


def test_equal_passages_are_stored_once(spark):
    passage = " ".join(f"w{i % 37}{i % 11}" for i in range(4000))
    rows = [(f"start{k} " + passage, "en") for k in range(50)]
    stored = phrase_mining.parse(spark.createDataFrame(rows, "text string, lang string"))
    assert stored.count() <= 50 + phrase_mining.parse(spark.createDataFrame(rows[:1], "text string, lang string")).count()
    assert stored.selectExpr("sum(owned * frequency)").first()[0] == 50 * 4001


def test_edges(spark):
    rows = [(None, "en"), ("", "en"), (" \t . ,", "en"), ("alone", None), ("a a a a a a a", "de"), ("A" * 70_000 + " b", "de"),
            ("a b " * 30_000, "long")]
    frame = spark.createDataFrame(rows, "text string, lang string")
    assert mined(frame, least=3, top=10) == brute(rows, 3, 10)
    assert mined(frame.limit(0)) == []


def test_products_beyond_64_bits(spark):
    big = 10 ** 15
    counts = spark.createDataFrame([("en", "a", big * 3, 1), ("en", "b", big * 2, 1), ("en", "a b", big, 2)], "lang string, phrase string, f long, words int")
    assert phrase_mining.scored(counts).first()["score"] == 2000000 * big // (5 * big)
