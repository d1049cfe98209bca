from __future__ import annotations

import pytest

from loomcrawl.plans import core_problems, core_queries, state_queries

QUERIES = core_problems.QUERIES | core_queries.QUERIES | state_queries.QUERIES
SQL = core_problems.SQL | core_queries.SQL | state_queries.SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(name, spark, small):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and df.columns == ["url", "cash", "history"]
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
