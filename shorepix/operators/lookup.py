"""Joins of a large table with one row per key, safe for hot keys."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 100_000
HOT_SHARE = 1000  # a key is hot from 1/1000 of all rows, so at most 1000 keys can be hot


def small_table(spark: SparkSession, rows: Sequence[tuple], columns: str) -> DataFrame:
    """Table of a few fixed rows that the optimizer holds as literals (no Python worker reads it)."""
    names = [part.split()[0] for part in columns.split(",")]
    values = list(zip(*rows)) if rows else [[] for _ in names]
    frame = spark.createDataFrame(pa.table({name: pa.array(list(column)) if rows else pa.array([], pa.string())
                                            for name, column in zip(names, values)}))
    return frame.select(*[F.col(name).cast(part.split(maxsplit=1)[1]).alias(name) for name, part in zip(names, columns.split(","))])


def local_if_small(table: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Materialize ``table`` once when it has at most ``max_rows`` rows.

    Reads at most ``max_rows + 1`` rows to the driver. A larger table is returned as it is,
    and the caller goes on with the distributed one.
    """
    rows = table.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        return table, False
    return table.sparkSession.createDataFrame(rows, table.schema), True


def broadcast_if_small(table: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Like :func:`local_if_small`, with a broadcast hint on the small result."""
    local, small = local_if_small(table, max_rows)
    return (F.broadcast(local), True) if small else (local, False)


def salted_lookup(big: DataFrame, per_key: DataFrame, keys: Sequence[str], how: str = "inner",
                  salts: int = 32, counts: DataFrame | None = None) -> DataFrame:
    """Join ``big`` with a table that has one row per key, spreading hot keys over ``salts`` tasks.

    One pass over the key columns counts rows per key (combined before the shuffle), unless
    ``counts`` (keys and __n) gives them. The few keys above 1/1000 of all rows get ``salts`` copies on the small side and a salt from
    the other columns on the big side; every other key keeps a single copy. The salt is a hash
    and no random number, so a task that is run again after a lost executor sends every row to
    the same place.
    """
    keys = list(keys)
    if counts is None:
        counts = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n")).scalar()
    hot = F.broadcast(counts.where(F.col("__n") * HOT_SHARE > total).select(*keys, F.lit(True).alias("__hot")))
    is_hot = F.col("__hot").isNotNull()
    others = [F.col(f"`{f.name}`") for f in big.schema.fields if f.name not in keys and f.dataType.typeName() != "map"]
    spread = F.when(is_hot, F.pmod(F.xxhash64(*others or [F.lit(0)]), F.lit(salts)).cast("int")).otherwise(0)
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    left = big.join(hot, keys, "left").withColumn("__salt", spread).drop("__hot")
    right = per_key.join(hot, keys, "left").withColumn("__salt", F.explode(copies)).drop("__hot")
    return left.join(right, [*keys, "__salt"], how).drop("__salt")


def attach(big: DataFrame, per_key: DataFrame, keys: Sequence[str], how: str = "left",
           max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast join behind a size check, salted shuffle join beyond it."""
    table, small = broadcast_if_small(per_key, max_rows)
    return big.join(table, list(keys), how) if small else salted_lookup(big, table, keys, how)


def override_predictions(main: DataFrame, refined: DataFrame, key: Sequence[str],
                         columns: Sequence[str]) -> DataFrame:
    """Replace ``columns`` of ``main`` by those of ``refined`` where it has a row for the key."""
    renamed = refined.select(*key, F.lit(True).alias("__refined"),
                             *[F.col(name).alias(f"__new_{name}") for name in columns])
    joined = main.join(renamed, list(key), "left")
    return joined.withColumns({
        name: F.when(F.col("__refined"), F.col(f"__new_{name}")).otherwise(F.col(name)) for name in columns
    }).drop("__refined", *[f"__new_{name}" for name in columns])
