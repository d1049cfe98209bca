from __future__ import annotations

import pytest

from loomcrawl.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_gives_a_result(name, spark, small):
    assert queries.QUERIES[name](spark, small).count() > 0
