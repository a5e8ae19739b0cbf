"""Where every named query and its SQL twin are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from peakwise.fixtures import Fixtures, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = ""):
    """Register ``fn(fixtures) -> DataFrame`` under ``name`` with its SQL twin."""

    def wrap(fn: Callable[[Fixtures], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Fixtures(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql, *views.split())
        return fn

    return wrap
