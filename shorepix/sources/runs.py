"""Run history files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import history as H


def append_run(run: DataFrame, path: str) -> None:
    run.select(*[field.name for field in S.HISTORY_SCHEMA.fields]).write.mode("append").json(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Readable history rows with ``position``, the order of the log."""
    lines = spark.read.text(path).select(
        "value", F.struct(F.col("_metadata.file_modification_time").alias("written"), F.col("_metadata.file_path").alias("file"),
                          F.monotonically_increasing_id().alias("line")).alias("position"))
    return H.parse_lines(lines)


def rewrite_runs(spark: SparkSession, path: str, target: str, keep: int = H.KEEP_RUNS) -> None:
    """Write the last ``keep`` runs to ``target``, oldest first."""
    kept = H.retained_runs(read_runs(spark, path), "position", keep)
    kept.orderBy("position").drop("position").write.mode("overwrite").json(target)
