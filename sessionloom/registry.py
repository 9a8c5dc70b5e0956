"""Queries of the library by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sessionloom.sources.fixtures import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers a function of (spark, sf_dir); ``oracle`` may use the views of ``sources.fixtures``."""

    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = with_views(oracle)
        return f

    return add
