"""Feature modes, band tables, class legend and label vocabulary."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Band orders, resolutions, classes and label aliases. They decide
# column order and class ids, so they are stated as they are, in natural order.
# ---------------------------------------------------------------------------

SPATIAL = "high_spatial_accuracy"
SPECTRAL = "high_spectral_complexity"
MODES = (SPATIAL, SPECTRAL)
DEFAULT_MODE = SPECTRAL

# Wavelength order: band stacks and spectral sequences.
SEQUENCE_BANDS = {
    SPATIAL: ("B02", "B03", "B04", "B08"),
    SPECTRAL: ("B01", "B02", "B03", "B04", "B05", "B06", "B07", "B08", "B8A", "B09", "B11", "B12"),
}
# Order of the raw inputs of dense models.
MODEL_BANDS = {
    SPATIAL: ("B02", "B03", "B04", "B08"),
    SPECTRAL: ("B02", "B03", "B04", "B08", "B05", "B06", "B07", "B11", "B12", "B8A", "B01", "B09"),
}
STACK_BANDS = SEQUENCE_BANDS[SPECTRAL]

# Native resolution in metres of every file a scene must hold.
BAND_RESOLUTION = {
    "B01": 60, "B02": 10, "B03": 10, "B04": 10, "B05": 20, "B06": 20, "B07": 20,
    "B08": 10, "B8A": 20, "B09": 60, "B11": 20, "B12": 20, "SCL": 20,
}
REFERENCE_BAND = "B02"

CLASS_LEGEND = (
    (1, "Bare Sediment", "#3e3d1b"),
    (2, "Sand", "#3e3d1b"),
    (3, "Chlorophyceae", "#99ff13"),
    (4, "Magnoliopsida", "#09861a"),
    (5, "Bacillariophyceae", "#ff9e36"),
    (6, "Phaeophyceae", "#a40205"),
    (7, "Florideophyceae", "#ff0004"),
    (8, "Water", "#3d2fff"),
)

# Concept, display name and accepted spellings, in matching order.
CONCEPTS = (
    ("bare_sediment", "Bare Sediment", ("bare sediment", "baresediment", "bare sediments", "sediment", "bare_sediment")),
    ("sand", "Sand", ("sand", "bare sand", "baresand")),
    ("chlorophyta", "Chlorophyta", ("chlorophyta", "chlorophyceae", "green algae", "greenalgae", "green_macroalgae", "green algae class", "ulvophyceae")),
    ("magnoliopsida", "Magnoliopsida", ("magnoliopsida", "magno", "seagrass", "zostera")),
    ("microphytobenthos", "Microphytobenthos", ("microphytobenthos", "bacillariophyceae", "mpb", "diatom", "diatoms")),
    ("phaeophyceae", "Phaeophyceae", ("phaeophyceae", "brown", "brown algae", "brownalgae")),
    ("rhodophyta", "Rhodophyta", ("rhodophyta", "florideophyceae", "rodo", "rhodo", "red algae", "redalgae")),
    ("water", "Water", ("water", "h2o")),
    ("vauch", "Vauch", ("vauch", "xanthophyceae")),
    ("unknown", "Unknown", ("unknown", "other", "unclassified", "nodata", "no data")),
)
CLASS_NUMBER_CONCEPT = {
    0: "unknown", 1: "bare_sediment", 2: "sand", 3: "chlorophyta", 4: "magnoliopsida",
    5: "microphytobenthos", 6: "phaeophyceae", 7: "rhodophyta", 8: "water", 9: "vauch", 10: "unknown",
}

SPECIALIST_BANDS = ("B03", "B04", "B05", "B08")
SPECIALIST_ROLE = "class4_class5"
# Spellings the two-class specialist accepts, by target label and output class id.
SPECIALIST_TARGETS = (
    ("Magnoliopsida", 4, ("magnoliopsida", "magno", "seagrass", "zostera", "4")),
    ("Microphytobenthos", 5, ("microphytobenthos", "mpb", "bacillariophyceae", "diatom", "diatoms", "5")),
)

MISSING_LABEL = "<MISSING>"
PRESENCE, ABSENCE = "Presence", "Absence"
DEFAULT_TARGET = "Magnoliopsida"
PRESENCE_NDVI = 0.246

# ---------------------------------------------------------------------------
# Names derived from the tables above
# ---------------------------------------------------------------------------


def raw_name(band: str) -> str:
    return f"Reflectance_{band}"


def stan_name(band: str) -> str:
    return f"Reflectance_Stan_{band}"


def is_raw(name: str) -> bool:
    return name.startswith("Reflectance_B")


def is_stan(name: str) -> bool:
    return name.startswith("Reflectance_Stan_")


def raw_of(name: str) -> str:
    """Raw column behind a raw or standardized column name."""
    return name.replace("Reflectance_Stan_", "Reflectance_")


def _profile(bands: Sequence[str]) -> tuple[str, ...]:
    return (*map(raw_name, bands), *map(stan_name, bands), "NDVI", "NDWI")


MODE_FEATURES = {mode: _profile(MODEL_BANDS[mode]) for mode in MODES}
SPECIALIST_FEATURES = _profile(SPECIALIST_BANDS)


def clean_names(names: Iterable[object] | None) -> list[str]:
    """Trimmed, non-empty names in first-seen order."""
    return list(dict.fromkeys(text for text in (str(name).strip() for name in names or ()) if text))


def resolve_mode(mode: str | None) -> str:
    key = re.sub(r"[- ]", "_", str(mode or DEFAULT_MODE).strip().lower())
    if key not in MODES:
        raise ValueError(f"Invalid feature mode '{mode}'. Use one of: {', '.join(MODES)}.")
    return key


def shorten(names: Sequence[str], shown: int = 12) -> str:
    extra = len(names) - shown
    return ", ".join(names[:shown]) + (f", +{extra} more" if extra > 0 else "")


def infer_mode(names: Iterable[object]) -> str:
    """Mode whose feature set equals ``names``, in any order."""
    wanted = clean_names(names)
    for mode in MODES:
        if set(wanted) == set(MODE_FEATURES[mode]):
            return mode
    known = {name for features in MODE_FEATURES.values() for name in features}
    strange = [name for name in wanted if name not in known]
    if strange:
        raise ValueError(f"Cannot infer a feature mode; unsupported input features: {shorten(strange)}")
    raise ValueError("Cannot infer a feature mode; the features match neither the spatial nor the spectral set.")


def sequence_groups(mode: str | None, standardised: bool = True) -> list[list[str]]:
    """Channel groups (raw, and standardized on request) of a spectral sequence."""
    bands = SEQUENCE_BANDS[resolve_mode(mode)]
    groups = [[raw_name(band) for band in bands]]
    if standardised:
        groups.append([stan_name(band) for band in bands])
    return groups


# ---------------------------------------------------------------------------
# Table schemas
# ---------------------------------------------------------------------------


HISTORY_SCHEMA = T.StructType([
    T.StructField("started_at", T.StringType()),
    T.StructField("workflow", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("duration_seconds", T.DoubleType()),
    T.StructField("input_path", T.StringType()),
    T.StructField("model_path", T.StringType()),
    T.StructField("output_path", T.StringType()),
    T.StructField("mask_path", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("details", T.StringType()),
    T.StructField("location_name", T.StringType()),
    T.StructField("mask_extent_coords", T.ArrayType(T.ArrayType(T.DoubleType()))),
])

REGISTRY_SCHEMA = T.StructType([
    T.StructField("model_name", T.StringType()),
    T.StructField("folder", T.StringType()),
    T.StructField("model_family", T.StringType()),
    T.StructField("feature_mode", T.StringType()),
    T.StructField("required_features", T.ArrayType(T.StringType())),
    T.StructField("sequence_features", T.ArrayType(T.StringType())),
    T.StructField("channel_groups", T.ArrayType(T.ArrayType(T.StringType()))),
    T.StructField("norm_mean", T.ArrayType(T.ArrayType(T.DoubleType()))),
    T.StructField("norm_std", T.ArrayType(T.ArrayType(T.DoubleType()))),
    T.StructField("specialist_role", T.StringType()),
    T.StructField("vocabulary", T.ArrayType(T.StringType())),
    T.StructField("class_ids", T.ArrayType(T.IntegerType())),
])

# A registry row with all that scoring needs; a model is (model_name, version).
MODEL_SCHEMA = T.StructType([
    *REGISTRY_SCHEMA.fields,
    T.StructField("version", T.IntegerType()),
    T.StructField("activation", T.StringType()),
    T.StructField("input_mean", T.ArrayType(T.DoubleType())),
    T.StructField("input_std", T.ArrayType(T.DoubleType())),
    T.StructField("input_fill", T.ArrayType(T.DoubleType())),
    T.StructField("flagged_features", T.ArrayType(T.StringType())),
    T.StructField("layers", T.ArrayType(T.StructType([
        T.StructField("weights", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("bias", T.ArrayType(T.DoubleType()))]))),
    T.StructField("convolutions", T.ArrayType(T.StructType([
        T.StructField("kernel", T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))), T.StructField("bias", T.ArrayType(T.DoubleType()))]))),
])
