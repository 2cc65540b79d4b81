"""Rules applied to class predictions (one-based output ids)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import reflectance as R
from .lookup import small_table

# Fixed values of the rules.
SEAGRASS, MICROALGAE, WATER = 4, 5, 8
SEAGRASS_NDVI = 0.25


def _is_finite(value: Column) -> Column:
    return F.coalesce(F.abs(value) < float("inf"), F.lit(False))


def is_water(ndwi: Column) -> Column:
    return _is_finite(ndwi) & (ndwi > 0)


def water_rule(class_id: Column, ndwi: Column) -> Column:
    """Class 8 wherever NDWI is finite and positive."""
    return F.when(is_water(ndwi), WATER).otherwise(class_id)


def is_low_seagrass(class_id: Column, ndvi: Column) -> Column:
    return (class_id == SEAGRASS) & _is_finite(ndvi) & (ndvi < SEAGRASS_NDVI)


def seagrass_rule(class_id: Column, ndvi: Column) -> Column:
    """Class 4 with a finite NDVI below 0.25 becomes class 5."""
    return F.when(is_low_seagrass(class_id, ndvi), MICROALGAE).otherwise(class_id)


def is_specialist_candidate(class_id: Column) -> Column:
    return class_id.isin(*[target[1] for target in S.SPECIALIST_TARGETS])


def seagrass_cover(class_id: Column, cover: Column) -> Column:
    return R.reported_cover(class_id, cover)


def relabel_counts(df: DataFrame, before: str, after: str) -> DataFrame:
    """Number of pixels per (before, after) pair that changed class."""
    return df.where(F.col(before) != F.col(after)).groupBy(before, after).agg(F.count(F.lit(1)).alias("n"))


def with_legend(df: DataFrame, class_id: str = "class_id") -> DataFrame:
    """Add class name and colour from the eight-row legend."""
    legend = small_table(df.sparkSession, S.CLASS_LEGEND, f"{class_id} int, class_name string, colour string")
    return df.withColumn(class_id, F.col(class_id).cast("int")).join(F.broadcast(legend), class_id, "left")
