"""Run history: parsing, keys, outcome, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import extents as X
from ..functions.staging import pinned

KEEP_RUNS, SHOWN_RUNS = 2000, 300  # fixed values: log length and view length


# Every field is read as text first, so that one odd value does not cost the whole line.
_TEXT_SCHEMA = T.StructType([T.StructField(f.name, T.StringType()) for f in S.HISTORY_SCHEMA.fields]
                            + [T.StructField("_bad", T.StringType())])


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """History rows of JSON text lines; unreadable lines and non-objects are dropped."""
    text = F.trim(F.col(column))
    parsed = F.from_json(text, _TEXT_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    run = F.when(text.startswith("{"), parsed)
    others = [name for name in lines.columns if name != column]
    rows = pinned(lines.select(*others, column), {"run": run}).where("run IS NOT NULL AND run._bad IS NULL")
    typed = {"duration_seconds": F.col("run.duration_seconds").try_cast("double"),
             "mask_extent_coords": F.from_json("run.mask_extent_coords", "array<array<double>>")}
    return rows.select(*others, *[typed.get(f.name, F.col(f"run.{f.name}")).alias(f.name) for f in S.HISTORY_SCHEMA.fields])


def detail_value(details: Column, key: str) -> Column:
    """Text behind ``key=`` in 'key=value; key=value' text (the last one of a repeated key)."""
    pattern = rf"^(?:.*;)?\s*\Q{key}\E\s*=([^;]*)"
    return F.when(details.rlike(pattern), F.trim(F.regexp_extract(details, pattern, 1)))


def details_map(details: Column) -> Column:
    """MAP of 'key=value; key=value' text (the last value of a repeated key wins)."""
    pairs = F.filter(F.split(F.coalesce(details, F.lit("")), r";\s*"), lambda part: F.contains(part, F.lit("=")))
    entries = F.transform(pairs, lambda part: F.struct(
        F.trim(F.split_part(part, F.lit("="), F.lit(1))).alias("key"),
        F.trim(F.regexp_replace(part, r"^[^=]*=", "")).alias("value")))
    last = F.filter(entries, lambda entry, i: ~F.exists(
        F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == entry["key"]))
    return F.map_from_entries(last)


def detail_number(details: Column, key: str) -> Column:
    return detail_value(details, key).try_cast("bigint")


def text_of(value: Column) -> Column:
    return F.trim(F.coalesce(value.cast("string"), F.lit("")))


def run_key() -> Column:
    return F.concat_ws("|", *[text_of(F.col(name)) for name in ("started_at", "workflow", "model_path", "output_path")])


def _is_masked_apply() -> Column:
    return (F.lower(text_of(F.col("workflow"))) == "apply") & (text_of(F.col("mask_path")) != "")


def needs_location() -> Column:
    """TRUE for masked runs whose place name is empty or coarse."""
    name = text_of(F.col("location_name"))
    return _is_masked_apply() & (name.isin("", "-") | ~(F.contains(name, F.lit(",")) | F.contains(name, F.lit("("))))


def needs_extent() -> Column:
    """TRUE for masked runs without four usable corner points."""
    return _is_masked_apply() & (F.size(X.checked_corners(F.col("mask_extent_coords"))) == 0)


def run_status(processed: Column, skipped: Column, failed: Column, aborted: Column) -> Column:
    """Outcome of one run from its scene counts."""
    return (
        F.when(aborted, "failed")
        .when((failed > 0) & ((processed > 0) | (skipped > 0)), "partial")
        .when(failed > 0, "failed")
        .when((processed > 0) & (skipped > 0), "partial")
        .when((processed == 0) & (skipped > 0), "skipped")
        .otherwise("success")
    )


def recent_runs(runs: DataFrame, n: int = SHOWN_RUNS, tie: str | None = None) -> DataFrame:
    """The n latest runs by start text. Each partition keeps n rows at most."""
    order = [F.desc(text_of(F.col("started_at")))] if tie is None else [F.desc(text_of(F.col("started_at"))), F.col(tie)]
    return runs.orderBy(*order).limit(n)


def retained_runs(runs: DataFrame, position: str, n: int = KEEP_RUNS) -> DataFrame:
    """The last n runs in log order (``position`` states that order)."""
    return runs.orderBy(F.desc(position)).limit(n)


def status_rollup(runs: DataFrame) -> DataFrame:
    """Runs and seconds per workflow and status."""
    return runs.groupBy("workflow", "status").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("duration_seconds").alias("seconds"))


def new_run(spark, **values) -> DataFrame:
    """One history row with trimmed, lower-cased and checked fields."""
    row = {field.name: values.get(field.name) for field in S.HISTORY_SCHEMA.fields}
    df = spark.createDataFrame([row], S.HISTORY_SCHEMA)
    texts = [f.name for f in S.HISTORY_SCHEMA.fields if f.dataType.typeName() == "string"]
    clean = df.withColumns({name: text_of(F.col(name)) for name in texts})
    return clean.withColumns({
        "workflow": F.lower("workflow"), "status": F.lower("status"),
        "duration_seconds": F.round(F.greatest(F.coalesce("duration_seconds", F.lit(0.0)), F.lit(0.0)), 3),
        "mask_extent_coords": X.checked_corners(F.col("mask_extent_coords")),
    })
