"""All named queries. The training-data problems join in only where their package is there."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomcrawl.plans import core_problems, core_queries, state_queries

Query = Callable[[SparkSession, str], DataFrame]


def _llm():
    """The module of the llm queries, or None where that package cannot be imported."""
    try:
        return importlib.import_module("loomcrawl.llm.queries")
    except ImportError:
        return None


def all_queries() -> dict[str, Query]:
    found = core_problems.QUERIES | core_queries.QUERIES | state_queries.QUERIES
    if llm := _llm():
        found |= llm.QUERIES
    return found


def all_sql() -> dict[str, str]:
    found = core_problems.SQL | core_queries.SQL | state_queries.SQL
    if llm := _llm():
        found |= llm.SQL
    return found


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return core_queries.opic_top(spark, folder)
