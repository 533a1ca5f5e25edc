"""Every query with SQL gives the same rows; the others run and give rows."""

import pytest
from compare import oracle_rows, spark_rows, views
from conftest import DATA

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return views(DATA)


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(n for n in ORACLES if not n.startswith("op")))
def test_same_rows(spark, con, name):
    columns, rows = spark_rows(QUERIES[name](spark, DATA))
    want_columns, want = oracle_rows(con, ORACLES[name])
    assert columns == want_columns
    assert rows == want


@pytest.mark.parametrize("name", ["pca_project", "ranker_importance", "ranker_ndcg", "vector_topk_lsh", "semantic_fitted"])
def test_rows_only(spark, name):
    assert QUERIES[name](spark, DATA).limit(1).count() == 1


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["prefix", "query", "score", "rk"]
    assert df.count() > 0
