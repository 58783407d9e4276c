"""Pareto order sampling against SQL and on edge cases."""

import duckdb
import pytest

from framelake.llm import pareto_mix


def rows_of(docs, table="t"):
    con = duckdb.connect()
    con.register(table, docs.toPandas())
    return sorted(con.sql(pareto_mix.oracle(table)).fetchall(), key=str)


def mixed_rows(docs):
    return sorted(map(tuple, pareto_mix.mix_table(docs).select("doc_id", "size", "source_size", "target", "taken").collect()), key=str)


def test_matches_sql_and_targets(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = mixed_rows(docs)
    assert got == rows_of(docs.select("doc_id", "source", "text"))
    by_source = {}
    for _doc, size, total, target, taken in got:
        assert taken in (0, size, 2 * size) and target <= 2 * total + 1e-9
        by_source.setdefault((total, target), []).append((size, taken))
    for (_total, target), docs_of in by_source.items():
        assert abs(sum(t for _, t in docs_of) - target) <= max(s for s, _ in docs_of) / 2 + 1e-6


def test_small_buckets_change_nothing(spark, small):
    sized = pareto_mix.cut(pareto_mix.sized_documents(spark.read.parquet(f"{small}/documents.parquet")))
    take = lambda n: sorted(map(tuple, pareto_mix.copies(sized, pareto_mix.plan_mix(sized, bucket_rows=n)).collect()))
    assert take(2) == take(10**6)


def test_excess_is_shared_again(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 20), (None, 1000)], "source string, source_size long")
    got = {r.source: r.target for r in pareto_mix.source_targets(sizes).collect()}
    assert got["a"] == 20 and got["c"] == 40  # both stop at twice their words
    left = 2030 * 1.5 - 60
    assert got["b"] == pytest.approx(left * 1 / 4) and got[None] == pytest.approx(2000 if left * 3 / 4 > 2000 else left * 3 / 4) or got[None] == 2000
    assert sum(got.values()) == pytest.approx(2030 * 1.5)


def test_edges(spark):
    rows = [(1, "a b c", "s", "x"), (1, "a b c", "s", "x"), (None, "q w", None, "x"), (3, None, "s", "x"), (4, "", "e", "x"),
            (5, "one two " * 5000, "s", "x"), (6, " \n\t ", "s", "x"), (7, "k", "t", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target string")
    got = mixed_rows(docs)
    assert len(got) == len(rows)
    assert [r for r in got if r[0] == 3] == [(3, 0, 10006, pytest.approx([g for g in got if g[0] == 5][0][3]), 0)]
    whole = pareto_mix.mixed(docs)
    assert whole.columns == docs.columns
    assert sum(len((r.text or "").split()) for r in whole.collect()) == sum(r[4] for r in got)
    assert pareto_mix.mix_table(docs.limit(0)).count() == 0


def test_query_reruns_agree(spark, small):
    run = lambda: sorted(map(tuple, pareto_mix.op2_pareto_mix(spark, small).collect()))
    assert run() == run()
