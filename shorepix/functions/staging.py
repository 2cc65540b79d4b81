"""Columns that are computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pinned(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add costly columns behind a one-row generator.

    The optimizer then neither copies their expressions into every later use nor rewrites
    later filters on them in terms of their inputs. Filters on other columns still pass.
    """
    kept = [F.col(f"`{name}`") for name in df.columns if name.lower() not in {new.lower() for new in columns}]
    return df.select(*kept, F.inline(F.array(F.struct(*[value.alias(name) for name, value in columns.items()]))))
