"""Scene identifiers, output names and label text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns of scene identifiers and file names.
SCENE_PATTERN = (
    r"(?i)^(S2[A-Z])_(MSIL[12][AC]?)_(\d{8}T\d{6})_(N\d{4})_(R\d{3})_(T[0-9A-Z]{5})_(\d{8}T\d{6})$"
)
SCENE_PARTS = ("mission", "level", "sensing_time", "baseline_code", "orbit", "tile", "product_time")
STATUS_FOLDER = r"(?i)[/\\](Done|Failed)[/\\]"


def base_name(path: Column) -> Column:
    return F.substring_index(F.rtrim(F.translate(path, "\\", "/"), F.lit("/")), "/", -1)


def scene_stem(path: Column) -> Column:
    """File or folder name without .zip, then .tif/.tiff, then .SAFE."""
    return F.regexp_replace(F.trim(base_name(path)), r"(?i)(\.safe)?(\.tiff?)?(\.zip)?$", "")


def is_scene_id(scene_id: Column) -> Column:
    return F.trim(scene_id).rlike(SCENE_PATTERN)


def scene_part(scene_id: Column, part: str) -> Column:
    text = F.regexp_extract(F.trim(scene_id), SCENE_PATTERN, SCENE_PARTS.index(part) + 1)
    return F.when(text != "", F.upper(text))


def acquired_at(scene_id: Column) -> Column:
    """Time from the first yyyymmddThhmmss text; NULL when absent or not a real time."""
    stamp = F.regexp_extract(scene_id, r"(\d{8}T\d{6})", 1)
    return F.try_to_timestamp(F.when(stamp != "", stamp), F.lit("yyyyMMdd'T'HHmmss"))


def processing_baseline(scene_id: Column) -> Column:
    """Number in the fourth underscore field, such as 511 in N0511."""
    return F.substring(F.split_part(scene_id, F.lit("_"), F.lit(4)), 2, 4).try_cast("int")


def model_stem(path: Column, drop_prefix: str | None = None) -> Column:
    """File-safe model name; ``drop_prefix`` is a regular expression removed from its start."""
    stem = F.regexp_replace(base_name(path), r"(.)\.[^.]*$", "$1")
    safe = trim_marks(F.regexp_replace(stem, r"[^\p{L}\p{N}._-]", "-"), "-_.")
    if drop_prefix is None:
        return safe
    short = trim_marks(F.regexp_replace(safe, f"(?i)^{drop_prefix}", ""), "-_.")
    return F.when(short != "", short).otherwise(safe)


def safe_stem(text: Column, fallback: str) -> Column:
    """Stem for report files: other characters as underscores, marks trimmed at both ends."""
    clean = trim_marks(F.regexp_replace(F.trim(text), r"[^\p{L}\p{N}._-]", "_"), "._")
    return F.when(clean != "", clean).otherwise(fallback)


def trim_marks(text: Column, marks: str) -> Column:
    return F.btrim(text, F.lit(marks))


def output_name(scene_path: Column, model_path: Column, tag: str = "classified",
                extension: str = ".tif", drop_prefix: str | None = None) -> Column:
    """``<scene>_<tag>_<model><extension>`` with fallbacks for empty parts."""
    scene, model = scene_stem(scene_path), model_stem(model_path, drop_prefix)
    return F.concat(
        F.when(scene != "", scene).otherwise(f"{tag}_output"), F.lit(f"_{tag}_"),
        F.when(model != "", model).otherwise("MODEL"), F.lit(extension),
    )


def integer_label(label: Column) -> Column:
    """Integer behind labels such as '3', '+3' or '3.0'; NULL for anything else."""
    text = F.trim(label)
    return F.when(text.rlike(r"^[+-]?\d+(\.0+)?$"),
                  F.regexp_replace(text, r"\.0+$", "").try_cast("bigint"))


def plain_label(label: Column) -> Column:
    """Lower-case letters and digits only (accents stay; see operators.labels for folding)."""
    return F.regexp_replace(F.lower(F.trim(label)), r"[^\p{L}\p{N}]", "")
