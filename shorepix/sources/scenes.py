"""Folder listings and archive contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from .files import per_file, tiff_bands, zip_members


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modified, size) of every file below ``folder``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def scene_listing(files: DataFrame) -> DataFrame:
    """Turn listed files into scene inputs: one row per outermost .SAFE folder, zip and TIFF file.

    A folder gets has_manifest and has_granule from the files below it. TIFF band counts are NULL here; they come from
    the headers (:func:`tiff_band_counts`) or from a table.
    """
    safe = F.regexp_extract("path", r"(?i)^(.*?\.safe)/", 1)
    rest = F.upper(F.substr(F.col("path"), F.length("safe") + 2))
    folders = (
        files.withColumn("safe", safe).where("safe <> ''").groupBy(F.col("safe").alias("path"))
        .agg(F.bool_or(rest == "MANIFEST.SAFE").alias("has_manifest"),
             F.bool_or(rest.startswith("GRANULE/")).alias("has_granule"))
    )
    others = files.where(safe == "").select("path")
    return folders.unionByName(others, allowMissingColumns=True).withColumn("band_count", F.lit(None).cast("int"))


def archive_members(spark: SparkSession, folder: str, trust_names: bool = True) -> DataFrame:
    """(path, member) of the zip files below ``folder``, or of ``folder`` itself if it is one.

    With ``trust_names`` archives named like a scene are left out, since their name already tells the id. Only the directory
    of an archive is read. Unreadable archives give no rows.
    """
    paths = list_files(spark, folder).where(F.lower("path").endswith(".zip"))
    if trust_names:
        paths = paths.where(~N.is_scene_id(N.scene_stem(F.col("path"))))
    return per_file(paths, zip_members, "member", "string", many=True)


def tiff_band_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(path, band_count) of the TIFF files below ``folder``, or of ``folder`` itself, from their headers."""
    paths = list_files(spark, folder).where(F.lower("path").rlike(r"\.tiff?$") & ~F.col("path").rlike(r"(?i)\.safe/"))
    return per_file(paths, tiff_bands, "band_count", "int")
