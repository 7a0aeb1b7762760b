"""The training-text queries against their SQL, and that all run."""

import pytest

from compare import same
from sievelake.llm import queries


@pytest.mark.parametrize("name", sorted(queries.sql()))
def test_same_as_sql(spark, data, name):
    same(spark, data, queries.QUERIES[name], queries.sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.sql())))
def test_runs(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    assert len(set(df.columns)) == len(df.columns) and df.count() > 0
