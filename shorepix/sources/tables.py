"""Labelled pixel tables, band tables and vector masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..operators.features import require_columns
from ..operators.raster import crop
from .files import first_line, per_file


def training_files(source: str | Sequence[str]) -> list[str]:
    """Load paths of a file, a folder or several files, sorted and without repeats."""
    if not isinstance(source, str):
        paths = sorted({str(path).strip() for path in source if str(path).strip()})
        if not paths:
            raise ValueError("At least one training CSV file is required.")
        wrong = [path for path in paths if not path.lower().endswith(".csv")]
        if wrong:
            raise ValueError(f"Training data file must be a CSV: {wrong[0]}")
        return paths
    if not source.strip():
        raise ValueError("A training data path is required.")
    return [source.strip()]


def header_groups(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, list[str]]]:
    """(header line, files) pairs. Reading files of unequal headers together would bind by position.

    Only the first block of each file is read for that.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(list(paths))
    headers = per_file(files, first_line, "header", "string").where("header <> ''")
    # The list of files is what the driver plans a scan from anyway.
    groups: dict[str, list[str]] = {}
    for row in headers.orderBy("path").collect():
        groups.setdefault(row["header"], []).append(row["path"])
    return list(groups.items())


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by column name, absent columns as NULL, entirely empty rows dropped."""
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame, allowMissingColumns=True)
    return merged.na.drop("all")


def read_csv_tables(spark: SparkSession, source: str | Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """All CSV files of ``source`` as text columns merged by name.

    ``columns`` limits the read to those columns (absent ones are skipped, as long as some remain).
    """
    groups = header_groups(spark, training_files(source))
    if not groups:
        raise FileNotFoundError(f"No CSV files were found in {source}")
    frames = []
    for _, files in groups:
        frame = spark.read.option("header", True).option("enforceSchema", False).csv(files)
        kept = [name for name in frame.columns if columns is None or name in columns]
        if kept:
            frames.append(frame.select(*[F.col(f"`{name}`") for name in kept]))
    return union_by_name(frames)


def read_training(spark: SparkSession, source: str | Sequence[str], label: str = "True_Class",
                  columns: Sequence[str] | None = None) -> DataFrame:
    """Training rows; a blank label anywhere is an error."""
    table = read_csv_tables(spark, source, columns)
    require_columns(table, [label], "Training data")
    if not table.where(F.trim(F.coalesce(F.col(label), F.lit(""))) == "").isEmpty():
        raise ValueError(f"Training data contains missing values in the {label} column.")
    return table


def read_specialist_training(spark: SparkSession, source: str | Sequence[str], label: str = "True_Class") -> DataFrame:
    """Only the label and the four raw specialist bands are read."""
    return read_csv_tables(spark, source, [label, *map(S.raw_name, S.SPECIALIST_BANDS)])


def read_validation(spark: SparkSession, path: str, label: str = "Label_Char") -> DataFrame:
    """Validation rows from CSV or Parquet with ``row_id``, the position used for first-seen order."""
    if not label.strip():
        raise ValueError("A label column name is required.")
    if path.lower().rstrip("/").endswith(".parquet"):
        table = spark.read.parquet(path)
    elif path.lower().endswith(".csv"):
        table = spark.read.option("header", True).csv(path)
    else:
        raise ValueError("Validation dataset must be a .csv or .parquet table.")
    if table.isEmpty():
        raise ValueError(f"Validation dataset is empty: {path}")
    if label not in table.columns:
        raise ValueError(f"Label column '{label}' was not found in validation dataset.")
    return table.withColumn("row_id", F.monotonically_increasing_id())


def read_bands(spark: SparkSession, path: str, scenes: Sequence[str] | None = None, bands: Sequence[str] | None = None,
               bounds: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Native band rows of a table partitioned by scene_id and band; all three filters reach the scan."""
    table = spark.read.parquet(path)
    if scenes is not None:
        table = table.where(F.col("scene_id").isin(*scenes))
    if bands is not None:
        table = table.where(F.col("band").isin(*bands))
    return table if bounds is None else crop(table, bounds, require_rows=True)


def write_grid(classified: DataFrame, path: str, layers: Sequence[str] | None = None) -> None:
    """Classified grid as float layers, one folder per scene; a rerun replaces only its own scenes."""
    layers = layers or ["out_class", "class_prob", "seagrass_cover", "ndvi"]
    out = classified.select("scene_id", "row", "col", *[F.col(name).cast("float").alias(name) for name in layers])
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scene_id").parquet(path))


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_chunks(df: DataFrame, path: str, rows_per_file: int = 10_000) -> None:
    """CSV files of at most ``rows_per_file`` rows, cut by the writer without a shuffle."""
    df.write.mode("overwrite").option("header", True).option("maxRecordsPerFile", rows_per_file).csv(path)


def report_names(dataset: str, model: str) -> tuple[str, str]:
    """Folder names of the predictions and metrics reports."""
    import re

    def stem(path: str, fallback: str) -> str:
        name = re.sub(r"(.)\.[^.]*$", r"\1", re.split(r"[/\\]", path.rstrip("/\\"))[-1])
        return re.sub(r"[^\w.-]", "_", name.strip()).strip("._") or fallback

    base = f"{stem(dataset, 'validation')}__{stem(model, 'model')}"
    return f"{base}__predictions.csv", f"{base}__metrics.csv"
