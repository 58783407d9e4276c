"""Every registered query against its SQL check on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check_oracles import compare, connect

CHECKS = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_matches_sql(spark, con, small, name):
    assert compare(con, QUERIES[name](spark, small), CHECKS[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CHECKS)))
def test_runs_without_sql(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(QUERIES)
