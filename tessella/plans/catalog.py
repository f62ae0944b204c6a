"""All queries over the provided tables, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function of the stand-in tables as a query, with its SQL."""
    from tessella.plans.bindings import Graph

    def register(function):
        key = name or function.__name__
        QUERIES[key] = lambda spark, sf_dir: function(Graph(spark, sf_dir))
        if sql:
            ORACLES[key] = sql
        return function

    return register


from tessella.plans import deletion, documents, evaluation, graphs, keyvalue, retrieval, vectors  # noqa: E402, F401  they register
