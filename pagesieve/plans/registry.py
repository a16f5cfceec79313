"""Registered queries: each name has a Spark plan and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, folder)`` under ``name`` with its oracle SQL."""

    def keep(fn):
        from pagesieve.session import tune, with_folder

        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: fn(with_folder(tune(spark)), folder)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep
