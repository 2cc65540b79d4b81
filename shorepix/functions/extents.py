"""Bounding boxes, extent corners and place names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXTENT_MARGIN = 60.0  # fixed value: padding in metres around a mask before cropping
MIN_TOLERANCE = 1e-6

Box = Sequence[Column]  # xmin, ymin, xmax, ymax


def box(prefix: str) -> Box:
    return [F.col(f"{prefix}{side}") for side in ("xmin", "ymin", "xmax", "ymax")]


def tolerance(x_resolution: Column, y_resolution: Column) -> Column:
    """Larger pixel side; a tiny positive number when that is unusable."""
    side = F.greatest(F.abs(x_resolution), F.abs(y_resolution))
    return F.when((side > 0) & (side < float("inf")), side).otherwise(MIN_TOLERANCE)


def grown(area: Box, margin: float = EXTENT_MARGIN) -> Box:
    return [area[0] - margin, area[1] - margin, area[2] + margin, area[3] + margin]


def overlaps(left: Box, right: Box, slack: Column) -> Column:
    return ((left[0] <= right[2] + slack) & (left[2] >= right[0] - slack)
            & (left[1] <= right[3] + slack) & (left[3] >= right[1] - slack))


def within(inner: Box, outer: Box, slack: Column) -> Column:
    return ((inner[0] >= outer[0] - slack) & (inner[1] >= outer[1] - slack)
            & (inner[2] <= outer[2] + slack) & (inner[3] <= outer[3] + slack))


def same_box(left: Box, right: Box, slack: Column) -> Column:
    result = F.lit(True)
    for one, other in zip(left, right):
        result = result & (F.abs(one - other) <= slack)
    return result


def intersection(left: Box, right: Box) -> Column:
    """STRUCT of the common box; NULL when it has no area."""
    xmin, ymin = F.greatest(left[0], right[0]), F.greatest(left[1], right[1])
    xmax, ymax = F.least(left[2], right[2]), F.least(left[3], right[3])
    common = F.struct(xmin.alias("xmin"), ymin.alias("ymin"), xmax.alias("xmax"), ymax.alias("ymax"))
    return F.when((xmin < xmax) & (ymin < ymax), common)


def extent_corners(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """[lat, lon] corners: south-west, north-west, north-east, south-east."""
    return F.array(F.array(ymin, xmin), F.array(ymax, xmin), F.array(ymax, xmax), F.array(ymin, xmax))


def checked_corners(points: Column) -> Column:
    """First four [lat, lon] points rounded to six digits; an empty array if any is unusable."""
    value = lambda point, i: F.coalesce(F.nanvl(F.get(point, F.lit(i)), F.lit(1e9)), F.lit(0.0))
    first = F.slice(F.coalesce(points, F.array().cast("array<array<double>>")), 1, 4)
    usable = F.forall(first, lambda point: F.coalesce(
        (F.size(point) >= 2) & value(point, 0).between(-90, 90) & value(point, 1).between(-180, 180),
        F.lit(False)))
    rounded = F.transform(first, lambda point: F.array(F.round(value(point, 0), 6), F.round(value(point, 1), 6)))
    return F.when((F.size(first) == 4) & usable, rounded).otherwise(F.array().cast("array<array<double>>"))


# Address keys by level, most specific first.
ADDRESS_LEVELS = (
    ("neighbourhood", "suburb", "borough", "quarter", "island", "archipelago", "hamlet"),
    ("village", "town", "city", "municipality", "locality", "county"),
    ("sea", "ocean", "waterway", "bay"),
    ("county", "state_district", "state", "region"),
)
ADDRESS_SCHEMA = T.StructType([
    T.StructField(key, T.StringType())
    for key in dict.fromkeys([key for level in ADDRESS_LEVELS for key in level] + ["country"])
])


def place_name(address: Column, lat: Column, lon: Column, absent: str = "None") -> Column:
    """Readable place from an address STRUCT.

    The first filled key of each level, then the country; repeated parts (ignoring case)
    are dropped, at most three parts stand before the country, and coordinates are the
    fallback. An absent level is written as ``absent``, which is how such records look.
    """
    field = lambda key: address.getField(key)

    def level(keys: Sequence[str]) -> Column:
        picked = [F.when(field(key) != "", field(key)) for key in keys[:-1]] + [field(keys[-1])]
        return F.trim(F.coalesce(*picked, F.lit(absent)))

    country = F.trim(F.coalesce(field("country"), F.lit(absent)))
    parts = F.filter(F.array(*[level(keys) for keys in ADDRESS_LEVELS], country), lambda part: part != "")
    unique = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda kept, part: F.when(
            F.exists(kept, lambda other: F.lower(other) == F.lower(part)), kept
        ).otherwise(F.concat(kept, F.array(part))),
    )
    before = F.slice(F.filter(unique, lambda part: F.lower(part) != F.lower(country)), 1, 3)
    with_country = F.concat(before, F.array(country))
    coordinates = F.format_string("%.4f, %.4f", lat, lon)
    return (
        F.when(country == "", F.when(F.size(unique) > 0, F.array_join(F.slice(unique, 1, 4), ", "))
               .otherwise(coordinates))
        .when(F.size(before) == 0, F.concat(country, F.lit(" ("), coordinates, F.lit(")")))
        .otherwise(F.array_join(with_country, ", "))
    )
