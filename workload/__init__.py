"""Queries over the given tables, with the SQL text that each one must agree with."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can state it, the equivalent text."""
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return add


def with_ctes(parts: list[tuple[str, str]], select: str) -> str:
    """WITH text from (name, body) pairs; bodies used repeatedly are computed once."""
    listed = ",\n".join(f"{name} AS MATERIALIZED ({body})" for name, body in parts)
    return f"WITH {listed}\n{select}"


def load_all() -> None:
    from . import catalogue, classification, features, history, labels, rasters, training  # noqa: F401


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every DOUBLE column."""
    from pyspark.sql import functions as F

    doubles = [name for name, kind in df.dtypes if kind == "double"]
    return reduce(lambda out, name: out.withColumn(name, F.round(name, digits)), doubles, df)
