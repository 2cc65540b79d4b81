"""Rules, smoothing and the complete classification of scenes."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from shorepix import schema as S
from shorepix.operators import features as X
from shorepix.operators import patches as P
from shorepix.operators import raster as G
from shorepix.operators import rules as Q
from shorepix.operators import scoring as C
from shorepix.plans.classify import classify_pixels, with_model_probabilities
from shorepix.session import shared_folder
from shorepix.sources.tables import write_grid

from . import derive as D
from . import query, rounded, with_ctes

GRID = ("grid", D.GRID_SQL)
PIXELS = [GRID, ("spx", D.SCENE_PIXELS_SQL)]
_MODEL, _SPECIAL = D.main_model(), D.specialist_model()

# Scene layers without a zero guard, then the main model, then the specialist.
_NDVI = '(("Reflectance_B08" - "Reflectance_B04") / nullif("Reflectance_B08" + "Reflectance_B04", 0))'
_NDWI = '(("Reflectance_B03" - "Reflectance_B08") / nullif("Reflectance_B08" + "Reflectance_B03", 0))'
_SCORED = [
    *PIXELS, *D.features_sql("spx", S.SEQUENCE_BANDS[S.SPATIAL], "a"), *D.dense_sql(_MODEL, "afeat", "m"),
    ("bsrc", "SELECT * FROM spx"),
    *D.features_sql("bsrc", S.SPECIALIST_BANDS, "b"), *D.dense_sql(_SPECIAL, "bfeat", "s"),
    ("main", f"""SELECT m.id, m.scene_id, m."row", m.col, m."Reflectance_B02" IS NOT NULL AS valid, {_NDVI.replace('"Refl', 'm."Refl')} AS ndvi, {_NDWI.replace('"Refl', 'm."Refl')} AS ndwi,
      CAST(list_position(mprobs, list_max(mprobs)) AS INTEGER) AS main_class, list_max(mprobs) AS main_prob,
      CAST(list_position(sprobs, list_max(sprobs)) AS INTEGER) + 3 AS special_class, list_max(sprobs) AS special_prob FROM mscored m JOIN sscored s ON s.id = m.id"""),
    ("refined", """SELECT *, CASE WHEN main_class IN (4, 5) THEN special_class ELSE main_class END AS class_id,
      CASE WHEN main_class IN (4, 5) THEN special_prob ELSE main_prob END AS class_prob FROM main"""),
]


def _scored(spark, folder):
    pixels = D.scene_pixels(spark, folder)
    work = with_model_probabilities(X.with_scene_indices(pixels), {"__main": _MODEL})
    return work.withColumns({"class_id": C.class_of(F.col("__main"), _MODEL.class_ids), "class_prob": F.array_max("__main")})


@query("specialist_override", with_ctes(_SCORED, 'SELECT id, class_id, round(class_prob, 6) AS class_prob FROM refined'))
def specialist_override(spark, folder):
    """Both networks in one pass over the pixels; the specialist's answer counts for its candidates."""
    work = with_model_probabilities(D.scene_pixels(spark, folder), {"__main": _MODEL, "__special": _SPECIAL})
    main, special = C.class_of(F.col("__main"), _MODEL.class_ids), C.class_of(F.col("__special"), _SPECIAL.class_ids)
    candidate = Q.is_specialist_candidate(main)
    return rounded(work.select("id", F.when(candidate, special).otherwise(main).alias("class_id"),
                               F.when(candidate, F.array_max("__special")).otherwise(F.array_max("__main")).alias("class_prob")))


@query("ndwi_water_rule", with_ctes(_SCORED, "SELECT id, CASE WHEN ndwi > 0 THEN 8 ELSE main_class END AS class_id, ndwi > 0 AS is_water FROM main"))
def ndwi_water_rule(spark, folder):
    return _scored(spark, folder).select("id", Q.water_rule(F.col("class_id"), F.col("NDWI")).alias("class_id"), (F.col("NDWI") > 0).alias("is_water"))


@query("ndvi_class45_rule", with_ctes([GRID], """SELECT id, CASE WHEN class_id = 4 AND o_totalprice / 1000000 < 0.25 THEN 5 ELSE class_id END AS class_id FROM grid"""))
def ndvi_class45_rule(spark, folder):
    return D.grid(spark, folder).select("id", Q.seagrass_rule(F.col("class_id"), F.col("o_totalprice") / 1000000).alias("class_id"))


@query("legend_join", with_ctes([GRID, ("legend", " UNION ALL ".join(f"SELECT {i} AS class_id, '{n}' AS class_name, '{c}' AS colour" for i, n, c in S.CLASS_LEGEND))],
                                "SELECT g.id, g.class_id, l.class_name, l.colour FROM grid g LEFT JOIN legend l ON l.class_id = g.class_id"))
def legend_join(spark, folder):
    return Q.with_legend(D.grid(spark, folder).select("id", "class_id")).select("id", "class_id", "class_name", "colour")


_VALID = ("vpx", "SELECT * FROM grid WHERE valid")


@query("patch_smoothing", with_ctes([GRID, _VALID, *D.patch_sql("vpx")], """SELECT g.scene_id, g."row", g.col, CAST(CASE WHEN NOT g.valid THEN -1 ELSE coalesce(w.replacement, g.class_id) END AS INTEGER) AS class_id
 FROM grid g LEFT JOIN lab l ON l.id = g.id LEFT JOIN winners w ON w.label = l.label"""))
def patch_smoothing(spark, folder):
    pixels = D.grid(spark, folder).select(*G.PIXEL, "valid", "class_id")
    return P.smooth_patches(pixels).select(*G.PIXEL, "class_id")


@query("patch_components", with_ctes([GRID, _VALID, *D.patch_sql("vpx")[:-3]], """SELECT g.scene_id, g."row", g.col, g.class_id, CAST(CASE WHEN NOT g.valid THEN -1 ELSE coalesce(p.n, 0) END AS INTEGER) AS patch_size
 FROM grid g LEFT JOIN lab l ON l.id = g.id LEFT JOIN patches p ON p.label = l.label"""))
def patch_components(spark, folder):
    pixels = D.grid(spark, folder).select(*G.PIXEL, "valid", "class_id")
    return P.patch_sizes(pixels).select(*G.PIXEL, "class_id", "patch_size")


def _classified_sql(smoothing: bool) -> str:
    ready = [*_SCORED, ("vpx", "SELECT id, scene_id, \"row\", col, CASE WHEN ndwi > 0 THEN 8 ELSE class_id END AS class_id, class_prob, ndvi FROM refined WHERE valid")]
    final = "v.class_id"
    join = ""
    if smoothing:
        ready += D.patch_sql("vpx")
        final = "coalesce(w.replacement, v.class_id)"
        join = "LEFT JOIN lab l ON l.id = v.id LEFT JOIN winners w ON w.label = l.label"
    ready += [("smooth", f"SELECT v.id, v.class_prob, v.ndvi, {final} AS c FROM vpx v {join}"),
              ("final", "SELECT *, CASE WHEN c = 4 AND ndvi < 0.25 THEN 5 ELSE c END AS out_class, least(greatest(172.06 * ndvi - 22.18, 0), 100) AS cover FROM smooth")]
    return with_ctes(ready, """SELECT g.scene_id, g."row", g.col, CAST(coalesce(f.out_class, -1) AS SMALLINT) AS out_class, round(coalesce(f.class_prob, -1), 6) AS class_prob,
 CASE WHEN f.out_class = 4 AND f.cover >= 20 THEN round(f.cover, 6) ELSE -1.0 END AS seagrass_cover, round(f.ndvi, 6) AS ndvi FROM spx g LEFT JOIN final f ON f.id = g.id""")


@query("classify_scene", _classified_sql(True))
def classify_scene(spark, folder):
    return rounded(classify_pixels(D.scene_pixels(spark, folder).drop("id"), _MODEL, _SPECIAL))


@query("classify_scene_unsmoothed", _classified_sql(False))
def classify_scene_unsmoothed(spark, folder):
    return rounded(classify_pixels(D.scene_pixels(spark, folder).drop("id"), _MODEL, _SPECIAL, smoothing=False))


@query("relabel_counts", with_ctes([*_SCORED], """SELECT main_class AS before, CASE WHEN ndwi > 0 THEN 8 ELSE main_class END AS after, count(*) AS n FROM main
 WHERE valid AND ndwi > 0 AND main_class <> 8 GROUP BY ALL"""))
def relabel_counts(spark, folder):
    work = G.valid_pixels(_scored(spark, folder), _MODEL.features)
    changed = work.select(F.col("class_id").alias("before"), Q.water_rule(F.col("class_id"), F.col("NDWI")).alias("after"))
    return Q.relabel_counts(changed, "before", "after")


@query("classification_counters", with_ctes(
    [*_SCORED, ("vpx", "SELECT id, scene_id, \"row\", col, CASE WHEN ndwi > 0 THEN 8 ELSE class_id END AS class_id, ndvi FROM refined WHERE valid"), *D.patch_sql("vpx"),
     ("smooth", "SELECT v.*, coalesce(w.replacement, v.class_id) AS c FROM vpx v LEFT JOIN lab l ON l.id = v.id LEFT JOIN winners w ON w.label = l.label")],
    """SELECT (SELECT count(*) FROM main WHERE valid AND main_class IN (4, 5)) AS specialist_candidates, (SELECT count(*) FROM main WHERE valid AND ndwi > 0) AS water,
 (SELECT count(*) FROM smooth WHERE c <> class_id) AS smoothed, (SELECT count(*) FROM smooth WHERE c = 4 AND ndvi < 0.25) AS seagrass_to_microalgae"""))
def classification_counters(spark, folder):
    """Counters of a complete classification, observed while its grid is written."""
    seen = Observation("relabelled")
    write_grid(classify_pixels(D.scene_pixels(spark, folder).drop("id"), _MODEL, _SPECIAL, counters=seen), f"{shared_folder(spark)}/grid")
    return spark.createDataFrame([seen.get], "specialist_candidates long, water long, smoothed long, seagrass_to_microalgae long")
