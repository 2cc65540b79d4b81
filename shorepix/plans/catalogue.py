"""Plan a batch: list, classify, resolve duplicates, separate finished from pending scenes."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalogue as K
from ..sources import scenes as Z


@dataclass
class Batch:
    candidates: DataFrame
    selected: DataFrame
    pending: DataFrame
    skipped: DataFrame
    summary: DataFrame


def _root(source: str) -> str:
    """The path part of ``source``, as it stands in listed paths."""
    return re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/", source).rstrip("/")


def scene_inputs(spark: SparkSession, source: str, tiff_bands: DataFrame | None = None) -> DataFrame:
    """Candidates (see ``catalogue.scene_candidates``) of a folder, a .SAFE folder, a zip archive or a TIFF image.

    Band counts come from the headers of the images unless a table (path, band_count) gives them. In a folder an archive
    counts by its file name; one that is given by itself also by its content, and it then has the id found inside.
    """
    listing = Z.scene_listing(Z.list_files(spark, source)).drop("band_count")
    bands = Z.tiff_band_counts(spark, source) if tiff_bands is None else tiff_bands
    listing = listing.join(bands, "path", "left")
    # Only what lies below the folder, or the single input by its name, decides about status folders.
    below = F.locate(_root(source), F.col("path"))
    single = re.search(r"(?i)\.(safe|zip|tiff?)$", _root(source)) is not None
    keep = len(_root(source).rsplit("/", 1)[0]) if single else len(_root(source))
    named = listing.withColumn("__whole", F.col("path")).withColumn(
        "path", F.when(below > 0, F.substr("path", below + keep)).otherwise(F.col("path")))
    found = K.scene_candidates(named, carry=["__whole"]).withColumn("path", F.col("__whole")).drop("__whole")
    if single and source.lower().rstrip("/").endswith(".zip"):
        inside = K.valid_archives(Z.archive_members(spark, source)).select("path", F.col("scene_id").alias("__inside"))
        found = found.join(inside, "path", "left").withColumns({
            "scene_id": F.coalesce("__inside", "scene_id"), "accepted": F.col("accepted") | F.col("__inside").isNotNull()}).drop("__inside")
    return found


def plan_batch(spark: SparkSession, source: str, model_path: str, outputs: DataFrame,
               tiff_bands: DataFrame | None = None, tag: str = "classified") -> Batch:
    """Batch plan for a folder or a single scene; ``outputs`` lists existing output names, ``tiff_bands`` (path, band_count)."""
    candidates = scene_inputs(spark, source, tiff_bands)
    records = K.with_acquisition(candidates.where("accepted").drop("accepted"))
    selected = K.with_output_name(K.preferred_scenes(records), model_path, tag)
    return Batch(candidates, K.catalogue_order(selected), K.pending_scenes(selected, outputs),
                 K.skipped_scenes(selected, outputs), K.batch_summary(candidates))


def require_inputs(candidates: DataFrame) -> None:
    """Fail when nothing usable was found."""
    if candidates.where("accepted").isEmpty():
        ignored = candidates.where(~F.col("accepted")).count()
        detail = f" Ignored {ignored} unsupported candidate(s)." if ignored else ""
        raise FileNotFoundError(f"No valid scene inputs were found.{detail}")
