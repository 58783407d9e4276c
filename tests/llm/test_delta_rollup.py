"""Signed deltas, idempotent commits, compaction, and the query against a recount."""

from collections import Counter

import pytest

from framelake.llm import bpe_ids
from framelake.llm.delta_rollup import CHANGES, RollupStore, op4_delta_rollup


def change(kind, key=(None, None, None), tokens=None, old=(None, None, None), old_tokens=None):
    return (kind, *key, tokens, *old, old_tokens)


A, B, NONE = ("s", "en", "v1"), ("s", "en", "v2"), (None, None, "v1")


@pytest.fixture
def store(spark, tmp_path):
    return RollupStore(spark, str(tmp_path / "rollup"))


def totals(store):
    return {tuple(r)[:3]: tuple(r)[3:] for r in store.totals().collect()}


def apply(spark, store, name, rows):
    return store.apply(name, spark.createDataFrame(rows, CHANGES).repartition(3))


def test_life_of_a_store(spark, store):
    assert totals(store) == {}
    assert apply(spark, store, "b1", [change("insert", A, 5), change("insert", A, 7), change("insert", NONE, None), change("insert", B, 1)])
    assert totals(store) == {A: (2, 12), NONE: (1, 0), B: (1, 1)}
    assert apply(spark, store, "b2", [change("revise", B, 9, A, 5), change("delete", B, 1)])
    want = {A: (1, 7), NONE: (1, 0), B: (1, 9)}
    assert totals(store) == want
    assert not apply(spark, store, "b2", [change("insert", A, 1000)])
    store.compact()
    assert totals(store) == want
    assert not apply(spark, store, "b1", [change("insert", A, 1000)])
    assert apply(spark, store, "b3", [change("delete", A, 7)])
    want.pop(A)
    assert totals(store) == want
    store.compact()
    assert totals(store) == want and not apply(spark, store, "b3", [change("delete", A, 7)])
    assert apply(spark, store, "empty", spark.createDataFrame([], CHANGES).collect() or []) and totals(store) == want


def test_a_batch_that_was_cut_off_is_written_over(spark, store, tmp_path):
    apply(spark, store, "b1", [change("insert", A, 5)])
    (tmp_path / "rollup" / "b1" / "_SUCCESS").unlink()
    assert totals(store) == {}
    assert apply(spark, store, "b1", [change("insert", A, 6)])
    assert totals(store) == {A: (1, 6)}


def test_errors(spark, store):
    with pytest.raises(ValueError):
        apply(spark, store, "../b", [])
    with pytest.raises(Exception, match="unknown change"):
        apply(spark, store, "b", [change("update", A, 5)])
    assert totals(store) == {}


def test_query(spark, small):
    whole = bpe_ids.encoder(bpe_ids.default_path()).whole
    toxic = {r.doc_id for r in spark.read.parquet(f"{small}/labels.parquet").collect() if r.toxic == 1}
    docs, tokens = Counter(), Counter()
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        if r.doc_id not in toxic:
            key = (r.source, r.lang, "bytes-1")
            docs[key] += 1
            tokens[key] += len(whole.encode(r.text, add_special_tokens=False).ids)
    assert {tuple(r)[:3]: tuple(r)[3:] for r in op4_delta_rollup(spark, small).collect()} == {k: (docs[k], tokens[k]) for k in docs}
