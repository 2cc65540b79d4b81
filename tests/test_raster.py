import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shorepix import schema as S
from shorepix.functions import extents as X
from shorepix.operators import mask as M
from shorepix.operators import raster as G
from shorepix.plans.classify import assemble_scene
from shorepix.plans.matching import match_images

SCENE = "S2A_MSIL2A_20250601T110651_N{}_R137_T29SQA_20250601T163114"


def test_resample_by_two_and_six_with_clamp(spark):
    fine = spark.createDataFrame([("s", r, c) for r in range(8) for c in range(8)], "scene_id string, row int, col int")
    for factor, side in ((2, 3), (6, 1)):
        coarse = spark.createDataFrame([("s", r, c, float(10 * r + c)) for r in range(side) for c in range(side)], "scene_id string, row int, col int, v double")
        for row in G.resample_nearest(fine, coarse, factor).collect():
            assert row["v"] == 10 * min(row["row"] // factor, side - 1) + min(row["col"] // factor, side - 1)


def native_bands(scene, size=12):
    """Every band pixel is 1000 + 100 * band number + its own row * size + col on its grid."""
    rows = []
    for number, (band, side) in enumerate(S.BAND_RESOLUTION.items()):
        n, step = size * 10 // side, side
        for r in range(n):
            for c in range(n):
                value = 4.0 if band == "SCL" else 1000.0 + 100 * number + r * n + c
                if band == "SCL" and (r, c) == (0, 1):
                    value = 11.0
                rows.append((scene, band, r, c, (c + 0.5) * step, size * 10 - (r + 0.5) * step, value))
    return rows


BANDS = "scene_id string, band string, row int, col int, x double, y double, value double"


def test_scene_assembly(spark):
    new, old = SCENE.format("0511"), SCENE.format("0300")
    bands = spark.createDataFrame(native_bands(new) + native_bands(old), BANDS)
    grid = {(row["scene_id"], row["row"], row["col"]): row for row in assemble_scene(bands).collect()}
    assert len(grid) == 288
    pixel = grid[new, 7, 5]
    assert pixel["Reflectance_B02"] == 100 + 7 * 12 + 5
    assert pixel["Reflectance_B05"] == 400 + 3 * 6 + 2 and pixel["Reflectance_B01"] == 1 * 2 + 0
    assert grid[old, 7, 5]["Reflectance_B02"] == 1100 + 7 * 12 + 5
    assert grid[new, 0, 2]["Reflectance_B02"] is None and grid[new, 1, 3]["scl"] is None and grid[new, 0, 4]["scl"] == 4.0


def test_scene_assembly_with_mask(spark):
    scene = SCENE.format("0511")
    bands = spark.createDataFrame(native_bands(scene, 60), BANDS)
    scenes = spark.createDataFrame([(scene, "m", 0.0, 600.0, 10.0, 60, 60, "EPSG:32629", "EPSG:32629")],
                                   "scene_id string, mask_id string, origin_x double, origin_y double, size double, n_rows int, n_cols int, crs string, mask_crs string")
    square = '{"type":"Polygon","coordinates":[[[400,50],[560,50],[560,150],[400,150],[400,50]]]}'
    edges = M.edges(M.rings_from_geojson(spark.createDataFrame([("m", 1, square), ("m", 2, None)], "mask_id string, geom_id int, geometry string")))
    grid = {(row["row"], row["col"]): row for row in assemble_scene(bands, mask_edges=edges, scenes=scenes).collect()}
    assert min(c for _, c in grid) == 34 and min(r for r, _ in grid) == 39 and max(r for r, _ in grid) == 59
    inside = {at for at, row in grid.items() if not row["study_site"]}
    assert inside == {(r, c) for r in range(45, 55) for c in range(40, 56)}
    assert grid[45, 40]["Reflectance_B02"] is not None and grid[44, 40]["Reflectance_B02"] is None
    far = M.edges(M.rings_from_wkt(spark.createDataFrame([("m", 1, "POLYGON ((900 900, 950 900, 950 950, 900 900))")], "mask_id string, geom_id int, geometry string")))
    with pytest.raises(ValueError, match="does not overlap"):
        M.crop_extents(far, scenes)
    with pytest.raises(ValueError, match="coordinate reference system"):
        M.crop_extents(edges, scenes.withColumn("mask_crs", F.lit("EPSG:4326")))


def test_polygon_text_forms(spark):
    wkt = "MULTIPOLYGON (((0 0, 40 0, 40 40, 0 40, 0 0), (10 10, 30 10, 30 30, 10 30, 10 10)), ((60 60, 80 60, 80 80, 60 60)))"
    rings = M.rings_from_wkt(spark.createDataFrame([("m", 1, wkt)], "mask_id string, geom_id int, geometry string")).orderBy("polygon", "ring_id").collect()
    assert [(row["polygon"], row["ring_id"], len(row["points"])) for row in rings] == [(0, 0, 5), (0, 1, 5), (1, 0, 4)]
    assert rings[1]["points"][1] == [30.0, 10.0]
    text = '{"type":"MultiPolygon","coordinates":[[[[0,0],[40,0],[40,40],[0,0]]],[[[60,60],[80,60],[80,80],[60,60]]]]}'
    assert M.rings_from_geojson(spark.createDataFrame([("m", 1, text)], "mask_id string, geom_id int, geometry string")).count() == 2


def test_mask_agrees_with_ray_casting(spark):
    rng = random.Random(3)
    polygons = [[(rng.uniform(0, 300), rng.uniform(0, 300)) for _ in range(7)] for _ in range(3)]
    rings = spark.createDataFrame([("m", i, 0, [[x, y] for x, y in ring]) for i, ring in enumerate(polygons)], "mask_id string, geom_id int, ring_id int, points array<array<double>>")
    pixels = spark.createDataFrame([("s", r, c) for r in range(30) for c in range(30)], "scene_id string, row int, col int")
    scenes = spark.createDataFrame([("s", "m", 0.0, 300.0, 10.0, 30)], "scene_id string, mask_id string, origin_x double, origin_y double, size double, n_rows int")
    out = {(row["row"], row["col"]): row["study_site"] for row in M.mark_study_site(pixels, M.edges(rings), scenes).collect()}

    def inside(x, y, ring):
        hit = False
        for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
            if (y0 <= y) != (y1 <= y) and x < x0 + (y - y0) * (x1 - x0) / (y1 - y0):
                hit = not hit
        return hit

    for (r, c), outside in out.items():
        assert outside != any(inside((c + 0.5) * 10, 300 - (r + 0.5) * 10, ring) for ring in polygons)
    box = M.bounds(M.edges(rings)).first()
    assert box["xmin"] == min(x for ring in polygons for x, _ in ring)


def test_crop_and_extents(spark):
    rows = spark.createDataFrame([(0.0, 0.0), (5.0, 5.0), (10.0, 10.0)], "x double, y double")
    assert G.crop(rows, (5, 10, 10, 5)).count() == 2
    with pytest.raises(ValueError, match="no pixels"):
        G.crop(rows, (50, 50, 60, 60), require_rows=True)
    one = spark.range(1)
    lit = lambda *v: [F.lit(float(x)) for x in v]
    got = one.select(
        X.intersection(lit(0, 0, 5, 5), lit(5, 0, 9, 9)), X.intersection(lit(0, 0, 5, 5), lit(4, 1, 9, 9)),
        X.overlaps(lit(0, 0, 5, 5), lit(5.5, 0, 9, 9), F.lit(1.0)), X.within(lit(-1, 0, 5, 5), lit(0, 0, 9, 9), F.lit(0.5)),
        X.same_box(lit(0, 0, 5, 5), lit(0.5, 0, 5, 5), F.lit(0.5)), X.tolerance(F.lit(float("nan")), F.lit(0.0))).first()
    assert got[0] is None and tuple(got[1]) == (4.0, 1.0, 5.0, 5.0) and list(got)[2:] == [True, False, True, 1e-6]


def test_layer_statistics_of_known_counts(spark):
    counts = {-1: 1509, 1: 109, 2: 26, 3: 8, 4: 2136, 5: 55, 6: 150, 7: 2, 8: 52}  # published class counts of one scene
    layer = spark.createDataFrame(list(counts.items()), "v int, n int").select("v", F.explode(F.sequence(F.lit(1), "n"))).select(F.col("v").cast("double"))
    stats = G.layer_statistics(layer, ["v"]).first()
    assert (stats["minimum"], stats["maximum"], stats["valid_percent"]) == (-1.0, 8.0, 100.0)
    assert stats["mean"] == pytest.approx(2.1806276254015) and stats["stddev"] == pytest.approx(2.5794497398042)
    histogram = {row["bucket"]: row["n"] for row in G.layer_histogram(layer, "v", -1, 9, 10).collect()}
    assert histogram == {value + 2: n for value, n in counts.items()}


def test_majority_ties_take_the_smaller_label(spark):
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (2, "c"), (2, "a")], "cell int, label string")
    assert {tuple(row) for row in G.majority_to_cell(rows, ["cell"], "label").collect()} == {(1, "a", 1, 2), (2, "c", 2, 3)}


def test_temporal_match_against_all_pairs(spark):
    rng, start = random.Random(2), datetime.date(2024, 1, 1)
    day = lambda: start + datetime.timedelta(days=rng.randrange(200))
    labels = [(i, rng.randrange(3) if i > 200 else 0, day()) for i in range(400)]  # one tile holds most rows
    images = [(rng.randrange(3), day()) for _ in range(25)]
    got = {row["id"]: (row["n_images"], row["nearest_day"], row["gap_days"]) for row in match_images(
        spark.createDataFrame(labels, "id int, tile int, day date"), spark.createDataFrame(images, "tile int, day date")).collect()}
    expected = {}
    for key, tile, when in labels:
        near = [other for t, other in images if t == tile and abs((other - when).days) <= 15]
        if near:
            best = min(near, key=lambda other: (abs((other - when).days), other))
            expected[key] = (len(near), best, abs((best - when).days))
    assert got == expected


def test_many_overlapping_geometries_and_many_scenes(spark):
    """10,000 overlapping squares on one row, and one mask over scenes that lie apart, against plain Python."""
    rng = np.random.default_rng(5)
    lows = rng.uniform(0, 5000, 10_000)
    rings = spark.range(10_000).select(F.lit("m").alias("mask_id"), F.col("id").cast("int").alias("geom_id"), F.lit(0).alias("ring_id"))
    places = spark.createDataFrame([(i, float(x), float(x + 3 + i % 40)) for i, x in enumerate(lows)], "geom_id int, a double, b double")
    corner = lambda x, y: F.array(F.col(x), F.lit(y))
    rings = rings.join(places, "geom_id").withColumn("points", F.array(corner("a", 1.0), corner("b", 1.0), corner("b", 19.0), corner("a", 19.0))).drop("a", "b")
    scenes = spark.createDataFrame([("s", "m", 0.0, 20.0, 10.0, 2, 520), ("t", "m", 1000.0, 20.0, 10.0, 2, 100), ("far", "m", 0.0, 900.0, 10.0, 2, 30)],
                                   "scene_id string, mask_id string, origin_x double, origin_y double, size double, n_rows int, n_cols int")
    spans = M.row_spans(M.edges(rings), scenes).orderBy("scene_id", "row", "first").collect()
    for name, origin, wide in (("s", 0.0, 520), ("t", 1000.0, 100)):
        centres = origin + (np.arange(wide) + 0.5) * 10.0
        inside = (centres[:, None] >= lows) & (centres[:, None] < lows + 3 + np.arange(10_000) % 40)
        for row in (0, 1):
            runs = [(r["first"], r["last"]) for r in spans if (r["scene_id"], r["row"]) == (name, row)]
            assert all(b + 1 < c for (_, b), (c, _) in zip(runs, runs[1:], strict=False))
            covered = np.zeros(wide, bool)
            for first, last in runs:
                covered[first:last + 1] = True
            assert (covered == inside.any(axis=1)).all()
    assert not [r for r in spans if r["scene_id"] == "far"]
    pixels = spark.range(520).select(F.lit("s").alias("scene_id"), F.lit(0).alias("row"), F.col("id").cast("int").alias("col"))
    flags = [r["study_site"] for r in M.mark_study_site(pixels, M.edges(rings), scenes).orderBy("col").collect()]
    centres = (np.arange(520) + 0.5) * 10.0
    assert flags == [not ((c >= lows) & (c < lows + 3 + np.arange(10_000) % 40)).any() for c in centres]
    assert M.mark_study_site(pixels.limit(0), M.edges(rings), scenes.drop("n_cols")).count() == 0
