"""Band tables and pixel grids: stacking, widening, resampling, masking, cropping, layer statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import reflectance as R
from .lookup import attach

PIXEL = ("scene_id", "row", "col")


def crop(df: DataFrame, bounds: tuple[float, float, float, float], require_rows: bool = False) -> DataFrame:
    """Rows whose centre lies in the box, edges included. Apply it to native bands, before any join."""
    xmin, ymin, xmax, ymax = bounds
    inside = df.where(F.col("x").between(min(xmin, xmax), max(xmin, xmax))
                      & F.col("y").between(min(ymin, ymax), max(ymin, ymax)))
    if require_rows and inside.isEmpty():
        raise ValueError("The crop window holds no pixels of this band.")
    return inside


def crop_to_extents(df: DataFrame, extents: DataFrame, key: str = "scene_id") -> DataFrame:
    """Crop every scene to its own box (columns xmin, ymin, xmax, ymax, one row per scene)."""
    joined = attach(df, extents.select(key, "xmin", "ymin", "xmax", "ymax"), [key], "inner")
    return joined.where(F.col("x").between(F.col("xmin"), F.col("xmax"))
                        & F.col("y").between(F.col("ymin"), F.col("ymax"))).drop("xmin", "ymin", "xmax", "ymax")


def check_stack(df: DataFrame, values: str = "values") -> DataFrame:
    """Fail on any row that does not hold exactly twelve bands."""
    count = F.size(F.col(values))
    message = F.concat(F.lit(f"A band stack must hold exactly {len(S.STACK_BANDS)} bands. Found "), count.cast("string"))
    return df.withColumn(values, F.when(count == len(S.STACK_BANDS), F.col(values)).otherwise(F.raise_error(message)))


def stack_to_bands(df: DataFrame, keys: Sequence[str], values: str = "values") -> DataFrame:
    """One row per band of a twelve-band stack."""
    names = F.array(*map(F.lit, S.STACK_BANDS))
    exploded = check_stack(df, values).select(*keys, F.posexplode(values).alias("position", "value"))
    return exploded.select(*keys, F.element_at(names, F.col("position") + 1).alias("band"),
                           F.col("value").cast("double").alias("value"))


def stack_to_wide(df: DataFrame, keys: Sequence[str], values: str = "values",
                  bands: Sequence[str] = S.STACK_BANDS) -> DataFrame:
    """Reflectance columns straight from the stack, without a shuffle."""
    return check_stack(df, values).select(*keys, *[
        F.element_at(F.col(values), S.STACK_BANDS.index(band) + 1).cast("double").alias(S.raw_name(band))
        for band in bands
    ])


def bands_to_wide(df: DataFrame, bands: Sequence[str], keys: Sequence[str] = PIXEL) -> DataFrame:
    """One row per pixel with a column per band; values are combined before the single shuffle."""
    wanted = df.where(F.col("band").isin(*bands))
    return wanted.groupBy(*keys).agg(*[
        F.max(F.when(F.col("band") == band, F.col("value"))).alias("scl" if band == "SCL" else S.raw_name(band))
        for band in bands
    ])


def grid_extent(pixels: DataFrame) -> DataFrame:
    """First and last row and column per scene."""
    return pixels.groupBy("scene_id").agg(F.min("row").alias("r0"), F.max("row").alias("r1"),
                                          F.min("col").alias("c0"), F.max("col").alias("c1"))


def extend_edges(coarse: DataFrame, coarse_extent: DataFrame, fine_extent: DataFrame, factor: int) -> DataFrame:
    """Repeat the edge pixels of a coarse grid outwards until it covers the fine grid of its scene.

    Only edge pixels are copied, and only where the coarse grid is the smaller one.
    """
    both = coarse_extent.join(fine_extent.withColumnsRenamed({n: f"fine_{n}" for n in ("r0", "r1", "c0", "c1")}), "scene_id")
    joined = attach(coarse, both, ["scene_id"], "left")

    def places(name: str, first: str, last: str) -> Column:
        place = F.col(name)
        low = F.when(place == F.col(first), F.least(place, F.floor(F.col(f"fine_{first}") / factor))).otherwise(place)
        high = F.when(place == F.col(last), F.greatest(place, F.floor(F.col(f"fine_{last}") / factor))).otherwise(place)
        return F.sequence(F.coalesce(low, place).cast("int"), F.coalesce(high, place).cast("int"))

    spread = joined.withColumn("row", F.explode(places("row", "r0", "r1"))).withColumn("col", F.explode(places("col", "c0", "c1")))
    return spread.select(*coarse.columns)


def join_coarse(fine: DataFrame, coarse: DataFrame, factor: int, block: Sequence[str] = ()) -> DataFrame:
    """Give fine pixels the values of the coarse pixel that holds them.

    With ``block`` columns, common to both sides and to their partitioning, the join runs on
    the block alone, so that neither side is shuffled again; the few coarse pixels of a block
    (nine at 20 m, one at 60 m) are told apart by a condition.
    """
    extra = [name for name in coarse.columns if name not in (*PIXEL, *block)]
    place = {name: F.floor(F.col(name) / factor).cast("int") for name in ("row", "col")}
    keys = [F.col("scene_id").alias("__scene"), *[F.col(name).alias(f"__{name}") for name in (*block, "row", "col")]]
    right = coarse.select(*keys, *extra)
    same = F.col("scene_id") == F.col("__scene")
    for name in block:
        same = same & (F.col(name) == F.col(f"__{name}"))
    for name, own in place.items():
        # A difference, not an equality, is no join key for the planner.
        same = same & ((own - F.col(f"__{name}") == 0) if block else (own == F.col(f"__{name}")))
    return fine.join(right, same, "left").select(*fine.columns, *extra)


def resample_nearest(fine: DataFrame, coarse: DataFrame, factor: int) -> DataFrame:
    """Give each fine pixel the values of the nearest coarse pixel of its scene.

    Both grids share their upper left corner and the coarse side is ``factor`` times the
    fine side, so the nearest centre is a floor division; beyond the coarse grid its edge
    pixels are repeated. That turns the nearest-neighbour search into an equi-join.
    """
    covered = extend_edges(coarse, grid_extent(coarse), grid_extent(fine), factor)
    return join_coarse(fine, covered, factor)


def remove_offset(df: DataFrame, names: Sequence[str], baseline: str = "baseline") -> DataFrame:
    """Subtract the radiometric offset from bands (never from the scene classification)."""
    return df.withColumns({name: R.remove_offset(F.col(baseline), F.col(name)) for name in names})


def apply_scl(df: DataFrame, names: Sequence[str], scl: str = "scl") -> DataFrame:
    """Null every listed column, and the flag itself, for masked scene classes."""
    return df.withColumns({name: R.scl_visible(F.col(scl), F.col(name)) for name in [*names, scl]})


def anchor_band(columns: Sequence[str], required: Sequence[str] = ()) -> str:
    """Raw band that decides validity: the first required one present, else the first present."""
    for name in [*S.clean_names(required), *columns]:
        if S.is_raw(name) and name in columns:
            return name
    raise ValueError("No raw reflectance columns are available.")


def is_valid(df: DataFrame, required: Sequence[str] = ()) -> Column:
    """TRUE where the anchor band has a value; other bands may be missing."""
    anchor = F.col(anchor_band(df.columns, required))
    if dict(df.dtypes)[anchor_band(df.columns, required)] in ("double", "float"):
        return anchor.isNotNull() & ~F.isnan(anchor)
    return anchor.isNotNull()


def valid_pixels(df: DataFrame, required: Sequence[str] = ()) -> DataFrame:
    return df.where(is_valid(df, required))


def majority_to_cell(df: DataFrame, cell: Sequence[str], label: str) -> DataFrame:
    """Most frequent label per cell (smallest label on ties), its count and the cell size."""
    counts = df.groupBy(*cell, label).agg(F.count(F.lit(1)).alias("__n"))
    return counts.groupBy(*cell).agg(
        F.min_by(label, F.struct(-F.col("__n"), F.col(label))).alias(label),
        F.max("__n").alias("n_label"), F.sum("__n").alias("n_pixels"))


def layer_statistics(df: DataFrame, layers: Sequence[str]) -> DataFrame:
    """Minimum, maximum, mean, population deviation and share of filled pixels per layer."""
    def usable(name: str) -> Column:
        value = F.col(name).cast("double")
        return F.when(~F.isnan(value), value)

    one = df.agg(*[
        F.struct(
            F.lit(name).alias("layer"), F.min(usable(name)).alias("minimum"), F.max(usable(name)).alias("maximum"),
            F.avg(usable(name)).alias("mean"), F.stddev_pop(usable(name)).alias("stddev"),
            (F.count(usable(name)) * 100.0 / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("valid_percent"),
        ).alias(f"l{i}") for i, name in enumerate(layers)])
    return one.select(F.explode(F.array(*[F.col(f"l{i}") for i in range(len(layers))])).alias("l")).select("l.*")


def layer_histogram(df: DataFrame, layer: str, low: float, high: float, buckets: int) -> DataFrame:
    """Counts of ``buckets`` equal intervals of [low, high); values outside fall into 0 and buckets + 1."""
    bucket = F.expr(f"width_bucket(cast(`{layer}` as double), {float(low)}D, {float(high)}D, {int(buckets)})")
    counted = df.select(bucket.alias("bucket")).where(F.col("bucket").isNotNull())
    return counted.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
