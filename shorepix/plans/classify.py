"""Apply a model to scenes: assemble, score, refine, smooth, report."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import names as N
from ..functions import reflectance as R
from ..operators import features as X
from ..operators import mask as M
from ..operators import patches as P
from ..operators import raster as G
from ..operators import rules as Q
from ..operators import scoring as C

BLOCK = ("block_row", "block_col")
LAYERS = ("out_class", "class_prob", "seagrass_cover", "ndvi")


def assemble_scene(bands: DataFrame, required: Sequence[str] = S.STACK_BANDS, mask_edges: DataFrame | None = None,
                   scenes: DataFrame | None = None) -> DataFrame:
    """10 m pixel table from native band rows (scene_id, band, row, col, x, y, value).

    Crop (where a mask is given), shuffle by 60 m block, widen each resolution on its own grid,
    join 20 m and 60 m pixels by floor division, remove the offset, apply the scene
    classification and the mask.
    """
    if mask_edges is not None:
        bands = G.crop_to_extents(bands, M.crop_extents(mask_edges, scenes))
    grid, fine_extent = None, G.grid_extent(bands.where(F.col("band") == S.REFERENCE_BAND))
    for side in (10, 20, 60):
        members = [band for band in [*required, "SCL"] if S.BAND_RESOLUTION[band] == side]
        if not members:
            continue
        native, factor = bands.where(F.col("band").isin(*members)), side // 10
        if side > 10:
            extent = G.grid_extent(bands.where(F.col("band") == members[0]))
            native = G.extend_edges(native, extent, fine_extent, factor)
        # Rows of all resolutions meet in their 60 m block: the one shuffle of each serves
        # both the widening and the joins.
        blocks = native.withColumns({name: F.floor(F.col(at) * factor / 6).cast("int") for name, at in zip(BLOCK, ("row", "col"))})
        wide = G.bands_to_wide(blocks.repartition("scene_id", *BLOCK), members, ["scene_id", *BLOCK, "row", "col"])
        grid = wide if grid is None else G.join_coarse(grid, wide, factor, BLOCK)
    grid = grid.drop(*BLOCK)
    names = [S.raw_name(band) for band in required]
    grid = grid.withColumn("baseline", N.processing_baseline(F.col("scene_id")))
    grid = G.apply_scl(G.remove_offset(grid, names), names).drop("baseline")
    return grid if mask_edges is None else M.apply_mask(grid, mask_edges, scenes, [*names, "scl"])


def _with_inputs(pixels: DataFrame, model: C.DenseModel, prefix: str) -> DataFrame:
    """Add the inputs of a dense model, rebuilt from raw bands, under prefixed names. In a scene a missing input is 0."""
    raw = [name for name in model.features if S.is_raw(name)]
    X.require_columns(pixels, raw, "Apply pixel table (raw inputs)")
    bands = pixels.select(*pixels.columns, F.struct(*pixels.columns).alias("__pixel"))
    built = X.with_feature_indices(X.with_standardised(bands, raw))
    return built.select(*[F.col(f"__pixel.`{name}`").alias(name) for name in pixels.columns],
                        *[R.filled(F.col(name)).alias(prefix + name) for name in model.features])


def with_model_probabilities(pixels: DataFrame, models: dict[str, C.DenseModel | C.SequenceModel]) -> DataFrame:
    """Add the probabilities of each model by target name; the pixel columns stay as they are.

    Dense models share one pass through the Arrow workers.
    """
    columns, work, dense, prefixes = list(pixels.columns), pixels, {}, {}
    for target, model in models.items():
        if isinstance(model, C.SequenceModel):
            flat = [name for group in model.groups for name in group]
            kept = work.select(F.struct(*work.columns).alias("__pixel"), *S.clean_names(map(S.raw_of, flat)))
            scored = C.score_sequence(X.sequence_table(kept, features=flat, groups=model.groups,
                                                       context="Apply pixel table", carry=["__pixel"]), model, target)
            work = scored.select("__pixel.*", target)
        else:
            prefixes[target] = f"__{target.strip('_')}_in_"
            work = _with_inputs(work, model, prefixes[target])
            dense[target] = model
    return (C.score_dense_all(work, dense, prefixes) if dense else work).select(*columns, *models)


def classify_pixels(pixels: DataFrame, model: C.Model, specialist: C.Model | None = None,
                    smoothing: bool = True, debug: bool = False, tile: int = P.TILE, counters: Observation | None = None) -> DataFrame:
    """Classified grid: out_class, class_prob, seagrass_cover and ndvi per pixel.

    Everything but the smoothing is one narrow stage. Invalid pixels keep -1, -1, -1 and NULL.
    The specialist is an expression over the same row, so replacing class and probability of
    its candidates needs no join. Either model may be a trained one (``plans.train``).

    ``counters`` observes the pass that computes the grid (a write, for instance): valid pixels that the specialist looked at,
    that a positive NDWI made water, that smoothing changed, and that went from class 4 to 5.
    """
    model, specialist = C.as_model(model), C.as_model(specialist)
    required = model.features if isinstance(model, C.DenseModel) else model.groups[0]
    work = X.with_scene_indices(pixels).withColumn("valid", G.is_valid(pixels, required))
    models = {"__main": model}
    if specialist is not None:
        missing = [name for name in specialist.features if S.is_raw(name) and name not in pixels.columns]
        if missing:
            warnings.warn(f"The specialist model was skipped: missing {S.shorten(missing)}", stacklevel=2)
        else:
            models["__special"] = specialist
    work = with_model_probabilities(work, models)
    work = work.withColumns({"class_id": C.class_of(F.col("__main"), model.class_ids), "class_prob": F.array_max("__main")})
    work = work.withColumn("__seen", Q.is_specialist_candidate(F.col("class_id")) & F.lit("__special" in models)) if counters else work
    if "__special" in models:
        candidate = Q.is_specialist_candidate(F.col("class_id"))
        work = work.withColumns({
            "class_prob": F.when(candidate, F.array_max("__special")).otherwise(F.col("class_prob")),
            "class_id": F.when(candidate, C.class_of(F.col("__special"), specialist.class_ids)).otherwise(F.col("class_id")),
        }).drop("__special")
    work = work.drop("__main").withColumn("class_id", Q.water_rule(F.col("class_id"), F.col("NDWI")))
    marks = ["__seen", "__wet", "__before"] if counters else []
    if counters:
        work = work.withColumns({"__wet": Q.is_water(F.col("NDWI")), "__before": F.col("class_id")})
    if not debug:
        work = work.select("scene_id", "row", "col", "valid", "class_id", "class_prob", "NDVI", "SPC", *marks)
    if smoothing:
        work = P.smooth_patches(work, "class_id", tile=tile)
    if counters:
        conditions = {"specialist_candidates": F.col("__seen"), "water": F.col("__wet"), "smoothed": F.col("class_id") != F.col("__before"),
                      "seagrass_to_microalgae": Q.is_low_seagrass(F.col("class_id"), F.col("NDVI"))}
        work = work.observe(counters, *[F.count_if(F.col("valid") & what).alias(name) for name, what in conditions.items()]).drop(*marks)
    work = work.withColumn("class_id", Q.seagrass_rule(F.col("class_id"), F.col("NDVI")))
    valid = F.col("valid")
    result = work.withColumns({
        "out_class": F.when(valid, F.col("class_id")).otherwise(-1).cast("smallint"),
        "class_prob": F.when(valid, F.col("class_prob")).otherwise(-1.0),
        "seagrass_cover": F.when(valid, F.coalesce(Q.seagrass_cover(F.col("class_id"), F.col("SPC")), F.lit(-1.0))).otherwise(-1.0),
        "ndvi": F.when(valid, F.col("NDVI")),  # takes the place of NDVI
    })
    if debug:
        return result.drop("valid", "class_id")
    return result.select("scene_id", "row", "col", *LAYERS)
