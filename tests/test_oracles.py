"""The correctness gate: every registered query against its DuckDB oracle (sf0.001)."""

import pytest

import __spark_entry__ as E
from litspark.plans.oracle_check import compare, duckdb_connection
from litspark.plans.registry import all_queries

SF = "/root/testdata/sf0.001"
QUERIES = {name: fn for name, (fn, _) in all_queries().items()}
ORACLES = {name: sql for name, (_, sql) in all_queries().items() if sql}


@pytest.fixture(scope="module")
def con():
    return duckdb_connection(SF)


def test_every_query_has_oracle_or_is_model():
    rows_only = set(QUERIES) - set(ORACLES)
    assert rows_only <= {"lda_topics", "select_k"}
    assert set(QUERIES) <= set(E.queries()) and set(ORACLES) <= set(E.oracle_sql())
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df())
    assert ok, msg


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_model_query_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() > 0


def test_entry_smoke(spark):
    out = E.entry(spark)
    assert out.columns == ["topic", "n_papers"] and out.count() > 0
