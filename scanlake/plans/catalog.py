"""Registry of named queries, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _one_dataset(f: Query, sql: str | None) -> Query:
    """Most queries' scan is one dataset, so its name is left out of their rows unless the SQL has it."""

    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = f(spark, sf_dir)
        return found.drop("dataset_id") if sql and "dataset_id" not in sql else found

    return run


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = _one_dataset(f, sql)
        if sql:
            ORACLES[name] = sql
        return f

    return add


def rounded(sql: str, digits: int = 6) -> str:
    """SQL that rounds and has no negative zero."""
    return f"(round({sql}, {digits}) + 0.0)"
