"""The grammar on hand-made clauses, learning from labels, held-out accuracy."""

import numpy as np
import pyarrow as pa
import pytest

from framelake.llm import toxicity
from framelake.llm.text_blocks import text_hash

PLAIN, AT, NOT, SAID, THREAT, WEAK = range(6)


@pytest.fixture(scope="module")
def listed():
    words = sorted(text_hash(w) for w in toxicity.LISTS[toxicity.INSULT])
    return toxicity.ToxicityModel({0: (np.array(words, np.uint64), np.ones(len(words)))})


@pytest.mark.parametrize("text,want", [
    ("What an idiot.", {PLAIN: 1}), ("You are an IDIOT!", {AT: 1}), ("idiot, you", {PLAIN: 1}), ("an idiot you are", {AT: 1}),
    ("you are not an idiot", {NOT: 1}), ("not even close to an idiot", {PLAIN: 1}), ("They said he is an idiot", {SAID: 1}),
    ("They said so. What an idiot", {PLAIN: 1}), ("I will kill you", {THREAT: 1}), ("to kill time", {WEAK: 1}),
    ("I will not kill you", {WEAK: 1}), ("idiot (loser) scum", {PLAIN: 3}), ("all quiet", {}), ("", {}), ("...", {}),
    ("du bist nicht stupid", {NOT: 1}), ("idioté moron", {PLAIN: 1})])
def test_clauses(listed, text, want):
    got = listed.features(pa.array([text], pa.large_string()))[0]
    assert got.tolist() == [want.get(k, 0) for k in range(6)]


@pytest.mark.parametrize("text,want", [
    ("you are an “idiot”", {AT: 1}), ("you are an idiot…", {AT: 1}), ("idiot\u00a0today", {PLAIN: 1}), ("«idiot»", {PLAIN: 1}),
    ("an idiot—you know", {PLAIN: 1}), ("an idiot\u2009you know", {AT: 1}), ("¡idiot!", {PLAIN: 1}), ("idiot。you", {PLAIN: 1}),
    ("you‘idiot’", {AT: 1}), ("idiot\u200byou", {AT: 1}), ("idiotñ “é” …", {}), ("“", {}), ("…idiot", {PLAIN: 1})])
def test_typographic_punctuation(listed, text, want):
    for texts in ([text], ["ñ", text, "…"]):
        got = listed.features(pa.array(texts, pa.large_string()))[len(texts) // 2]
        assert got.tolist() == [want.get(k, 0) for k in range(6)]


def test_plain_keeps_every_byte_in_place():
    texts = ["", "a“b”c… — ñ 漢字。", None, "x\u3000y\uff01"]
    got = toxicity.plain(pa.array([t or "" for t in texts], pa.large_string()).slice(1))
    assert [len(t.encode()) for t in got.to_pylist()] == [len((t or "").encode()) for t in texts[1:]]
    assert got.to_pylist()[0].split() == ["a", "b", "c.", ".", "ñ", "漢字."]


def test_composition_equals_the_machines_side_by_side():
    rng = np.random.default_rng(4)
    one, two = toxicity.negation(2), toxicity.reported()
    both = toxicity.compose(one, two)
    for _ in range(200):
        a = b = c = 0
        for symbol in rng.integers(0, 6, 12).tolist():
            a, x = one.move(a, symbol)
            b, y = two.move(b, symbol)
            c, z = both.move(c, symbol)
            assert z == x | y


def test_slices_do_not_matter(listed):
    texts = ["you idiot", "", "scum. not a fool", "x " * 50000 + "you clown"]
    together = listed.features(pa.array(texts, pa.large_string()))
    alone = np.vstack([listed.features(pa.array([t], pa.large_string())) for t in texts])
    assert np.array_equal(together, alone)


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in toxicity.op1_toxicity(spark, folder).collect()}
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= .5) for r in got.values())
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [(got[d].predicted, t) for d, t in toxic.items() if got[d].held_out]
    assert sum(p == t for p, t in held) / len(held) >= .95
    assert not any(p and not t for p, t in held)


def test_learns_words_no_list_has(spark):
    rows = [(i, f"plain words {i} here " + ("grumpf you" if i % 4 == 0 else "kind you")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all((got[i] >= .5) == (i % 4 == 0) for i in range(400))


def test_edges(spark):
    rows = [(None, "you stupid loser", 1), (1, None, 1), (2, "", 1), (2, "", 1), (3, "you idiot " * 30000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(None, 1), (1, None), (2, 7)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert sorted(r.score >= .5 for r in got) == [False, False, False, True, True]
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=str) == [1, 2, 2]
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.learn(docs.limit(0), labels.limit(0)).bias == toxicity.PRIOR_BIAS
