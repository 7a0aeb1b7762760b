"""Every core query with SQL against DuckDB; the others run and have their columns."""

import pytest

from compare import same
from sievelake.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_as_sql(spark, data, name):
    same(spark, data, catalogue.QUERIES[name], catalogue.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, data, name):
    df = catalogue.QUERIES[name](spark, data)
    assert len(set(df.columns)) == len(df.columns)
    assert df.count() > 0


def test_entry(spark, data):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(catalogue.QUERIES) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_ivf_recall(spark, data):
    exact = {(r["query_id"], r["id"]) for r in catalogue.QUERIES["knn_join_top10"](spark, data).collect()}
    found = {(r["query_id"], r["id"]) for r in catalogue.QUERIES["ivf_top10"](spark, data).collect()}
    assert len(exact & found) >= 0.9 * len(exact)
