"""Feature tables: checks, coercion, derived columns, spectral sequences."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import reflectance as R


def require_columns(df: DataFrame, names: Iterable[str], context: str) -> list[str]:
    wanted = S.clean_names(names)
    missing = [name for name in wanted if name not in df.columns]
    if missing:
        raise ValueError(f"{context} is missing required columns: {S.shorten(missing)}")
    return wanted


def _is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def coerce_numeric(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """DOUBLE columns; unreadable text and NaN become NULL."""
    return df.withColumns({name: R.numeric(F.col(name), _is_text(df, name)) for name in names})


def with_standardised(df: DataFrame, raw_names: Sequence[str]) -> DataFrame:
    """Add (or overwrite) the standardized column of every raw column.

    Row minimum and range are computed once in their own projection; Spark keeps such a
    projection separate when its results are used several times.
    """
    values = [R.numeric(F.col(name), _is_text(df, name)) for name in raw_names]
    staged = df.withColumns({"__floor": R.row_floor(values), "__range": R.row_range(values)})
    floor, value_range = F.col("__floor"), F.col("__range")
    return staged.withColumns({
        name.replace("Reflectance_", "Reflectance_Stan_"): R.standardise(value, floor, value_range)
        for name, value in zip(raw_names, values)
    }).drop("__floor", "__range")


def _bands(df: DataFrame, *bands: str) -> list[Column]:
    names = [S.raw_name(band) for band in bands]
    return [R.numeric(F.col(name), _is_text(df, name)) for name in names]


def with_feature_indices(df: DataFrame) -> DataFrame:
    """NDVI and NDWI as model features (0 for a zero denominator)."""
    require_columns(df, map(S.raw_name, ("B03", "B04", "B08")), "Derived-feature preprocessing")
    green, red, nir = _bands(df, "B03", "B04", "B08")
    return df.withColumns({"NDVI": R.guarded_index(nir, red), "NDWI": R.guarded_index(green, nir)})


def with_scene_indices(df: DataFrame) -> DataFrame:
    """NDVI, NDWI and potential seagrass cover as scene layers (NULL for a zero denominator)."""
    green, red, nir = _bands(df, "B03", "B04", "B08")
    layers = df.withColumns({"NDVI": R.raw_index(nir, red), "NDWI": R.raw_index(green, nir)})
    return layers.withColumn("SPC", R.potential_cover(F.col("NDVI")))


class Origin(NamedTuple):
    """What a mode derives from raw bands unless told otherwise, and what its stored columns are called in errors."""

    derive: tuple[str, ...]
    stored: str


BANDS, INDICES = "bands", "indices"  # standardized bands; NDVI and NDWI
ORIGINS = {S.SPATIAL: Origin((BANDS, INDICES), "spatial-mode raw inputs"), S.SPECTRAL: Origin((), "spectral-mode inputs")}


def _kind(name: str) -> str | None:
    return BANDS if S.is_stan(name) else INDICES if name in ("NDVI", "NDWI") else None


def prepare_features(df: DataFrame, mode: str | None = None, names: Iterable[object] | None = None, *, context: str,
                     derive: Iterable[str] | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """Model inputs in the order of ``names`` (default: all of the mode), behind the ``carry`` columns.

    ``derive`` says which inputs are made from raw bands, in place of columns of the same name: BANDS, INDICES, both or
    none; the default is that of the mode. All others are read from the table. Without a mode it follows from the names.
    """
    wanted = S.clean_names(names)
    if not wanted and (names is not None or mode is None):
        raise ValueError("Give a feature mode or at least one input name.")
    mode = S.infer_mode(wanted) if mode is None else S.resolve_mode(mode)
    ordered = wanted or S.MODE_FEATURES[mode]
    made = ORIGINS[mode].derive if derive is None else tuple(derive)
    raw = [S.raw_name(band) for band in S.MODEL_BANDS[mode]] if made else []
    require_columns(df, [*raw, *(name for name in ordered if _kind(name) not in made)], f"{context} ({ORIGINS[mode].stored})")
    table = with_standardised(df, raw) if BANDS in made else df
    table = with_feature_indices(table) if INDICES in made else table
    return table.select(*carry, *ordered)


def training_table(df: DataFrame, mode: str | None = None, label: str = "True_Class") -> DataFrame:
    """Label plus ordered features."""
    require_columns(df, [label], "Training data")
    return prepare_features(df, S.resolve_mode(mode), context="Training data", carry=[label])


def specialist_features(df: DataFrame, *, context: str, carry: Sequence[str] = ()) -> DataFrame:
    """The ten specialist inputs from raw bands, missing values as 0."""
    raw_names = [S.raw_name(band) for band in S.SPECIALIST_BANDS]
    require_columns(df, raw_names, f"{context} (specialist raw inputs)")
    built = with_feature_indices(with_standardised(coerce_numeric(df, raw_names), raw_names))
    return built.select(*carry, *[R.filled(F.col(name)).alias(name) for name in S.SPECIALIST_FEATURES])


def sequence_table(df: DataFrame, mode: str | None = None, features: Iterable[object] | None = None,
                   groups: Sequence[Sequence[object]] | None = None, *, context: str,
                   carry: Sequence[str] = ()) -> DataFrame:
    """Ordered raw and standardized columns of a spectral sequence, rebuilt from raw bands."""
    channel_groups = [group for group in (S.clean_names(group) for group in groups or ()) if group]
    channel_groups = channel_groups or S.sequence_groups(mode)
    names = S.clean_names(features) or [name for group in channel_groups for name in group]
    strange = [name for name in names if not (S.is_raw(name) or S.is_stan(name))]
    if strange:
        raise ValueError(f"{context} includes unsupported sequence feature '{strange[0]}'. "
                         "Only raw and standardized reflectance inputs are supported.")
    raw_names = S.clean_names(map(S.raw_of, names))
    require_columns(df, raw_names, f"{context} (raw sequence inputs)")
    built = with_standardised(coerce_numeric(df.select(*carry, *raw_names), raw_names), raw_names)
    return built.select(*carry, *[R.filled(F.col(name)).alias(name) for name in names])


def sequence_array(groups: Sequence[Sequence[str]], norm: dict | None = None) -> Column:
    """ARRAY of channels, each an ARRAY of band values, optionally normalized."""
    def cell(channel: int, position: int, name: str) -> Column:
        if norm is None:
            return F.col(name)
        return R.z_score(F.col(name), norm["mean"][channel][position], norm["std"][channel][position])

    return F.array(*[
        F.array(*[cell(channel, position, name) for position, name in enumerate(group)])
        for channel, group in enumerate(groups)
    ])


def sequence_statistics(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per input: mean and population deviation, non-finite values as 0, deviation 0 as 1."""
    stats = df.agg(*[
        F.struct(F.lit(name).alias("feature"),
                 F.avg(R.finite(F.col(name))).alias("mean"),
                 F.stddev_pop(R.finite(F.col(name))).alias("std")).alias(f"s{i}")
        for i, name in enumerate(names)
    ])
    long = stats.select(F.explode(F.array(*[F.col(f"s{i}") for i in range(len(names))])).alias("s"))
    deviation = F.col("s.std")
    return long.select("s.feature", "s.mean", F.when(deviation > 0, deviation).otherwise(1.0).alias("std"))


def sequence_norm(df: DataFrame, groups: Sequence[Sequence[str]]) -> dict[str, list[list[float]]]:
    """Channel-shaped statistics for :func:`sequence_array` (two numbers per input, read once)."""
    names = [name for group in groups for name in group]
    rows = {row["feature"]: row for row in sequence_statistics(df, names).collect()}
    return {key: [[rows[name][key] for name in group] for group in groups] for key in ("mean", "std")}


def is_missing(name: str) -> Column:
    return F.coalesce(F.isnan(F.col(name)), F.lit(False)) | F.col(name).isNull()


def missing_flag(name: str) -> str:
    return f"{name}_na"


def impute_medians(df: DataFrame, names: Sequence[str], medians: dict[str, float | None],
                   flagged: Iterable[str] = ()) -> DataFrame:
    """Fill missing features with training medians; ``flagged`` ones get a ``<name>_na`` column that says where."""
    out = df.withColumns({missing_flag(name): is_missing(name) for name in flagged}) if flagged else df
    return out.withColumns({name: F.when(is_missing(name), F.lit(medians[name])).otherwise(F.col(name)) for name in names})


def incomplete_features(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Names of the columns that miss a value somewhere."""
    found = df.agg(*[F.max(is_missing(name)).alias(f"m{i}") for i, name in enumerate(names)]).first()
    return [name for i, name in enumerate(names) if found[f"m{i}"]]


# -- name lists held in tables ------------------------------------------------------------


def clean_name_list(names: Column) -> Column:
    """Trimmed, non-empty names of an ARRAY in first-seen order."""
    trimmed = F.transform(names, lambda name: F.trim(name))
    return F.array_distinct(F.filter(trimmed, lambda name: name != ""))


def mode_of_features(names: Column) -> Column:
    """Mode whose feature set equals the ARRAY; NULL when none does."""
    ordered = F.array_sort(clean_name_list(names))
    result = F.lit(None).cast("string")
    for mode in reversed(S.MODES):
        result = F.when(ordered == F.array(*map(F.lit, sorted(S.MODE_FEATURES[mode]))), F.lit(mode)).otherwise(result)
    return result


def unsupported_features(names: Column) -> Column:
    known = sorted({name for features in S.MODE_FEATURES.values() for name in features})
    return F.array_except(clean_name_list(names), F.array(*map(F.lit, known)))


def required_bands(mode: Column, specialist_bands: Column) -> Column:
    """Bands of the mode followed by the specialist bands that are new."""
    bands = F.array().cast("array<string>")
    for name in reversed(S.MODES):
        bands = F.when(mode == name, F.array(*map(F.lit, S.SEQUENCE_BANDS[name]))).otherwise(bands)
    return F.array_union(bands, F.coalesce(specialist_bands, F.array().cast("array<string>")))
