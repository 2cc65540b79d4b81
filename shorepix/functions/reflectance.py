"""Reflectance, index and probability expressions. Missing values are NULL throughout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the seagrass-cover line and of the pixel masks.
COVER_SLOPE, COVER_OFFSET, COVER_MINIMUM = 172.06, 22.18, 20.0
MASKED_SCL = (1, 11)
OFFSET_BASELINE, OFFSET_VALUE = 399, 1000

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_INFINITY = r"^\s*([+-]?)[iI][nN][fF]([iI][nN][iI][tT][yY])?\s*$"


def numeric(value: Column, is_text: bool = False) -> Column:
    """DOUBLE, with unreadable text and NaN as NULL."""
    if is_text:
        sign = F.when(F.regexp_extract(value, _INFINITY, 1) == "-", F.lit("-Infinity")).otherwise("Infinity")
        value = F.when(value.rlike(_NUMBER), F.trim(value)).when(value.rlike(_INFINITY), sign)
    number = value.try_cast("double")
    return F.when(~F.isnan(number), number)


def filled(value: Column) -> Column:
    """Value with NULL and NaN replaced by 0."""
    return F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))


def finite(value: Column) -> Column:
    """Value with NULL, NaN and both infinities replaced by 0."""
    return F.when(F.abs(value) < float("inf"), value).otherwise(0.0)


def row_floor(values: Sequence[Column]) -> Column:
    return F.least(*values) if len(values) > 1 else values[0]


def row_range(values: Sequence[Column]) -> Column:
    return (F.greatest(*values) if len(values) > 1 else values[0]) - row_floor(values)


def standardise(value: Column, floor: Column, value_range: Column) -> Column:
    """Position of ``value`` in the range of its row; 0 for a constant or empty row."""
    return F.when(value_range > 0, (value - floor) / value_range).otherwise(0.0)


def guarded_index(first: Column, second: Column) -> Column:
    """(first - second) / (first + second); 0 for a zero denominator, NULL for a NULL input."""
    total = first + second
    return F.when(total == 0, 0.0).otherwise((first - second) / total)


def raw_index(first: Column, second: Column) -> Column:
    """(first - second) / (first + second); NULL for a zero denominator."""
    return F.try_divide(first - second, first + second)


def potential_cover(ndvi: Column) -> Column:
    return ndvi * COVER_SLOPE - COVER_OFFSET


def reported_cover(class_id: Column, cover: Column) -> Column:
    """Cover clipped to 0..100 for class 4 from the minimum up, -1 elsewhere."""
    clipped = F.least(F.greatest(cover, F.lit(0.0)), F.lit(100.0))
    return F.when((class_id == 4) & (clipped >= COVER_MINIMUM), clipped).otherwise(-1.0)


def scl_visible(scl: Column, value: Column) -> Column:
    """NULL for saturated or defective pixels and for snow; a missing flag keeps the value."""
    return F.when(F.coalesce(scl.isin(*MASKED_SCL), F.lit(False)), None).otherwise(value)


def remove_offset(baseline: Column, value: Column) -> Column:
    """Undo the radiometric offset that processing baselines above 399 carry."""
    return F.when(baseline > OFFSET_BASELINE, value - OFFSET_VALUE).otherwise(value)


def z_score(value: Column, mean: float | None, std: float | None) -> Column:
    """(value - mean) / std with unusable statistics as 0 and 1 and non-finite results as 0."""
    usable = lambda number: number is not None and abs(number) < float("inf")
    centre = float(mean) if usable(mean) else 0.0
    scale = float(std) if usable(std) and std > 0 else 1.0
    return finite((finite(value) - F.lit(centre)) / F.lit(scale))


def argmax(probabilities: Column) -> Column:
    """One-based position of the first maximum."""
    return F.array_position(probabilities, F.array_max(probabilities)).cast("int")
