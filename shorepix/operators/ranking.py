"""Row numbers, exact splits and order statistics without one task per group.

A plain ``row_number`` window sends a whole group to one task. Here each group is cut into
ordered buckets; counts per bucket (combined before the shuffle) give every bucket its
offset, and only rows inside one bucket are sorted together.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .lookup import attach

HASH_BUCKETS = 1 << 16


def bucketed_row_number(df: DataFrame, group: Sequence[str], order: Sequence[Column], bucket: Column,
                        name: str = "rank") -> DataFrame:
    """Row number from 1 within ``group`` along ``order``.

    ``bucket`` must not decrease along ``order`` and must hold a bounded number of rows.
    Counting and numbering shuffle on the same keys.
    """
    group = list(group)
    keyed = df.withColumn("__bucket", bucket)
    counts = keyed.groupBy(*group, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    running = W.partitionBy(*group).orderBy(F.col("__bucket").asc_nulls_first())
    offsets = counts.select(
        *[F.col(column).alias(f"__g{i}") for i, column in enumerate(group)],
        F.col("__bucket").alias("__b"),
        (F.sum("__n").over(running.rowsBetween(W.unboundedPreceding, 0)) - F.col("__n")).alias("__offset"),
    )
    same = F.col("__bucket").eqNullSafe(F.col("__b"))
    for i, column in enumerate(group):
        same = same & F.col(column).eqNullSafe(F.col(f"__g{i}"))
    inside = F.row_number().over(W.partitionBy(*group, "__bucket").orderBy(*order))
    return (
        keyed.join(offsets, same)
        .withColumn(name, F.col("__offset") + inside)
        .drop("__bucket", "__offset", "__b", *[f"__g{i}" for i in range(len(group))])
    )


def number_chunks(df: DataFrame, key: str, rows_per_chunk: int = 10_000, width: int = 1_000_000) -> DataFrame:
    """``chunk`` = four-digit (or longer) number of the consecutive block a row falls in.

    ``key`` is a unique integer that states the row order; ``width`` is the key span that
    is sorted in one task.
    """
    ranked = bucketed_row_number(df, [], [F.col(key)], F.floor(F.col(key) / width), "__rank")
    number = F.ceil(F.col("__rank") / rows_per_chunk).cast("string")
    return ranked.withColumn("chunk", F.lpad(number, F.greatest(F.lit(4), F.length(number)), F.lit("0"))).drop("__rank")


def hash_order(keys: Sequence[str], seed: int) -> Column:
    """Reproducible shuffle position of a row."""
    return F.xxhash64(*[F.col(key) for key in keys], F.lit(seed))


def _split(df: DataFrame, group: list[str], order: Column, bucket: Column, wanted: Column,
           ties: Sequence[str]) -> DataFrame:
    """Flag the first ``wanted`` rows of every group along ``order``.

    Only rows of the one bucket that the boundary cuts are ranked; all others are decided
    by comparing bucket numbers. A NULL in ``group`` is a group like any other: the joins go by
    a struct of the group columns, which is never NULL itself and equals one with the same NULLs.
    """
    keyed = df.withColumns({"__order": order, "__bucket": bucket})
    if group:
        keyed = keyed.withColumn("__group", F.struct(*group))
    key = ["__group"] if group else []
    counts = keyed.groupBy(*key, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    totals = counts.groupBy(*key).agg(F.sum("__n").alias("n"))
    totals = totals.select(*key, wanted.alias("__wanted"))
    running = W.partitionBy(*key).orderBy("__bucket").rowsBetween(W.unboundedPreceding, 0)
    cumulative = counts.withColumn("__upto", F.sum("__n").over(running))
    if group:
        bounds = cumulative.join(totals, key)
    else:
        bounds = cumulative.withColumn("__wanted", totals.select("__wanted").scalar())
    # The cut bucket is the first whose running count reaches the wanted count.
    cut = (
        bounds.where(F.col("__upto") >= F.col("__wanted"))
        .groupBy(*key)
        .agg(F.min("__bucket").alias("__cut"),
             F.min_by(F.col("__wanted") - F.col("__upto") + F.col("__n"), "__bucket").alias("__rest"))
    )
    if group:
        # One row per group: broadcast behind a size check, so that the rows are not shuffled.
        flagged = attach(keyed, cut, key, "inner")
    else:
        one = cut.select(F.struct("__cut", "__rest").alias("s")).scalar()
        flagged = keyed.withColumn("__s", one).select(
            "*", F.col("__s.__cut").alias("__cut"), F.col("__s.__rest").alias("__rest")).drop("__s")
    decided = flagged.where(F.col("__bucket") != F.col("__cut")).withColumn(
        "is_valid", F.col("__bucket") < F.col("__cut"))
    place = F.row_number().over(W.partitionBy(*key, "__bucket").orderBy("__order", *ties))
    ranked = flagged.where(F.col("__bucket") == F.col("__cut")).withColumn(
        "is_valid", place <= F.col("__rest"))
    return decided.unionByName(ranked).drop("__order", "__bucket", "__cut", "__rest", *key)


def stratified_split(df: DataFrame, label: str, keys: Sequence[str], valid_share: float = 0.3,
                     seed: int = 42, order: Column | None = None, bucket: Column | None = None) -> DataFrame:
    """Add ``is_valid``: per label, round(n * share) rows (half to even), at least 1 and at most n - 1.

    Rows with a NULL label are one class. ``keys`` identify a row. ``order`` and ``bucket`` replace the default hash order.
    """
    small = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < 2)
    if not small.isEmpty():
        raise ValueError("Every class needs at least two rows so that both splits are filled.")
    order = hash_order(keys, seed) if order is None else order
    bucket = F.shiftright(order, 48) if bucket is None else bucket
    wanted = F.greatest(F.lit(1), F.least(F.col("n") - 1, F.bround(F.col("n") * F.lit(valid_share)).cast("bigint")))
    return _split(df, [label], order, bucket, wanted, list(keys))


def random_split(df: DataFrame, keys: Sequence[str], valid_share: float = 0.3, seed: int = 42,
                 order: Column | None = None, bucket: Column | None = None) -> DataFrame:
    """Add ``is_valid`` for exactly floor(n * share) rows, chosen by a seeded hash."""
    order = hash_order(keys, seed) if order is None else order
    bucket = F.shiftright(order, 48) if bucket is None else bucket
    wanted = F.floor(F.col("n") * F.lit(valid_share)).cast("bigint")
    return _split(df, [], order, bucket, wanted, list(keys))


#: Bits of the ordered form of a double that each pass over the rows settles, most significant first.
DIGITS = (22, 21, 21)
_HALF = 11


@F.arrow_udf(T.ArrayType(T.LongType()))
def _ordered_bits(batch: pa.Array) -> pa.Array:
    """Of each double in a struct a long that is ordered alike; NULL for NULL and NaN."""
    keys, gone = [], []
    for i in range(batch.type.num_fields):
        x = batch.field(i).to_numpy(zero_copy_only=False).astype(float) + 0.0  # no negative zero
        bits = x.view(np.int64)
        keys.append(np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits))
        gone.append(np.isnan(x))
    flat, width = np.column_stack(keys).ravel(), batch.type.num_fields
    values = pa.array(flat, mask=np.column_stack(gone).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width, dtype=np.int32)), values)


def _value_of(key: int) -> float:
    return float(np.array([key if key >= 0 else key ^ ((1 << 63) - 1)], np.int64).view(float)[0])


def _any_of(found: Iterable[tuple[int, int]], bits: Column) -> Column:
    """Whether (c, ``bits``) of a row is among these pairs."""
    by_column: dict[int, list[int]] = {}
    for c, value in found:
        by_column.setdefault(c, []).append(value)
    return reduce(or_, [(F.col("c") == c) & bits.isin(sorted(set(values))) for c, values in by_column.items()])


def _settle(counts: DataFrame, drop: int, grown: int, targets: list[tuple[int, int | None, int]]) -> list[tuple[int, int, int]]:
    """Targets (column, leading bits or None, rank among the values that begin so) with ``grown`` more bits each.

    ``counts`` (c, bits, n) holds ``drop`` bits beyond those.
    """
    sums: dict[int, list[tuple[int, int]]] = {}
    for row in counts.groupBy("c", F.shiftright("bits", drop).alias("b")).agg(F.sum("n").alias("n")).collect():
        sums.setdefault(row["c"], []).append((row["b"], row["n"]))
    out = []
    for c, known, rank in targets:
        for bits, n in sorted(sums[c]):
            if known is None or bits >> grown == known:
                if rank < n:
                    out.append((c, bits, rank))
                    break
                rank -= n
    return out


def exact_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Exact median of every column by radix selection: three passes over the rows for all columns together.

    Each pass counts the next 21 or 22 bits of the ordered form of the values that share the leading bits known so far. The
    counts are kept as a table; from it first the upper half of these bits is settled, then the lower half, so the driver
    sees at most 2,048 counts per column and middle value at a time. NULL and NaN are left out; a column without values
    has no median.
    """
    columns = list(columns)
    keys = _ordered_bits(F.struct(*[F.col(f"`{name}`").cast("double").alias(f"f{i}") for i, name in enumerate(columns)]))
    rows = df.select(F.posexplode(keys).alias("c", "key")).where(F.col("key").isNotNull())
    targets: list[tuple[int, int | None, int]] = []
    left = 64
    for digit in DIGITS:
        inside = rows.where(_any_of([(c, known) for c, known, _ in targets], F.shiftright("key", left))) if targets else rows
        left -= digit
        counts = cut_lineage(inside.groupBy("c", F.shiftright("key", left).alias("bits")).agg(F.count(F.lit(1)).alias("n")))
        if not targets:
            sizes = {row["c"]: row["n"] for row in counts.groupBy("c").agg(F.sum("n").alias("n")).collect()}
            if not sizes:
                break
            targets = [(c, None, rank) for c, n in sizes.items() for rank in ((n - 1) // 2, n // 2)]
        upper = _settle(counts, _HALF, digit - _HALF, targets)
        near = counts.where(_any_of([(c, known) for c, known, _ in upper], F.shiftright("bits", _HALF)))
        targets = _settle(near, 0, _HALF, upper)
    result: dict[str, float | None] = dict.fromkeys(columns)
    for c, key, _ in targets:
        value, before = _value_of(key), result[columns[c]]
        result[columns[c]] = value if before is None else (before + value) / 2
    return result
