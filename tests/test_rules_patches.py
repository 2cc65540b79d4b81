import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shorepix import schema as S
from shorepix.operators import patches as P
from shorepix.operators import rules as Q
from shorepix.operators import scoring as C
from shorepix.plans.classify import classify_pixels


def grid_frame(spark, classes, valid=None, scene="s"):
    rows = [(scene, r, c, int(v), True if valid is None else bool(valid[r][c])) for r, line in enumerate(classes) for c, v in enumerate(line)]
    return spark.createDataFrame(rows, "scene_id string, row int, col int, class_id int, valid boolean")


def to_grid(df, height, width, column="class_id"):
    out = np.full((height, width), 99)
    for row in df.collect():
        out[row["row"], row["col"]] = row[column]
    return out


def brute_force(cls, valid):
    """Flood fill over the whole grid, then the majority around each small patch."""
    height, width = cls.shape
    seen, out, sizes = np.zeros(cls.shape, bool), cls.copy(), np.zeros(cls.shape, int)
    for r0 in range(height):
        for c0 in range(width):
            if seen[r0, c0] or not valid[r0, c0]:
                continue
            stack, members = [(r0, c0)], set()
            seen[r0, c0] = True
            while stack:
                r, c = stack.pop()
                members.add((r, c))
                for dr in (-1, 0, 1):
                    for dc in (-1, 0, 1):
                        a, b = r + dr, c + dc
                        if 0 <= a < height and 0 <= b < width and valid[a, b] and not seen[a, b] and cls[a, b] == cls[r0, c0]:
                            seen[a, b] = True
                            stack.append((a, b))
            if len(members) > 9:
                continue
            rows, cols = [m[0] for m in members], [m[1] for m in members]
            around = {}
            for r in range(max(0, min(rows) - 2), min(height, max(rows) + 3)):
                for c in range(max(0, min(cols) - 2), min(width, max(cols) + 3)):
                    if valid[r, c] and (r, c) not in members:
                        around[cls[r, c]] = around.get(cls[r, c], 0) + 1
            total = sum(around.values())
            for r, c in members:
                sizes[r, c] = len(members)
            if total >= 8:
                best = max(around, key=around.get)
                if 2 * around[best] > total and best != cls[r0, c0]:
                    for r, c in members:
                        out[r, c] = best
    return out, sizes


def test_water_and_seagrass_rules(spark):
    rows = spark.createDataFrame([(2, -0.1, 0.24), (4, 0.2, 0.26), (5, 0.0, None), (4, None, 0.24), (4, float("inf"), float("nan"))], "c int, ndwi double, ndvi double")
    got = [tuple(row) for row in rows.select(Q.water_rule(F.col("c"), F.col("ndwi")), Q.seagrass_rule(F.col("c"), F.col("ndvi"))).collect()]
    assert got == [(2, 2), (8, 4), (5, 5), (4, 5), (4, 4)]


def test_cover_rule(spark):
    rows = spark.createDataFrame([(4, 55.0), (4, 19.9), (4, 20.0), (4, 140.0), (5, 90.0), (4, None)], "c int, spc double")
    assert [row[0] for row in rows.select(Q.seagrass_cover(F.col("c"), F.col("spc"))).collect()] == [55.0, -1.0, 20.0, 100.0, -1.0, -1.0]


@pytest.mark.parametrize("size,block,fill,changed", [(3, [(1, 1)], 3, True), (5, [(1, 1), (1, 2), (2, 1), (2, 2)], 3, True),
                                                     (6, [(r, c) for r in range(1, 5) for c in range(1, 5)], 3, False)])
def test_small_patches(spark, size, block, fill, changed):
    cls = np.ones((size, size), int)
    for r, c in block:
        cls[r, c] = fill
    out = to_grid(P.smooth_patches(grid_frame(spark, cls)), size, size)
    assert (out == (1 if changed else cls)).all()


@pytest.mark.parametrize("seed", range(4))
def test_tiles_agree_with_whole_grid(spark, seed):
    rng = random.Random(seed)
    height, width = 33, 29
    cls = np.array([[1 + (r // 6 + c // 7) % 3 if rng.random() > 0.25 else rng.randint(1, 4) for c in range(width)] for r in range(height)])
    for _ in range(4):  # thin snakes of about nine pixels
        r, c = rng.randrange(height - 10), rng.randrange(width - 10)
        for i in range(rng.randint(8, 11)):
            cls[r + i if i < 10 else r, min(width - 1, c + i % 10)] = 4
    valid = np.array([[rng.random() > 0.1 for _ in range(width)] for _ in range(height)])
    smooth, sizes = brute_force(cls, valid)
    frame = grid_frame(spark, cls, valid)
    for tile in (7, 256):
        assert (to_grid(P.smooth_patches(frame, tile=tile), height, width) == np.where(valid, smooth, -1)).all()
    assert (to_grid(P.patch_sizes(frame, tile=16), height, width, "patch_size") == np.where(valid, sizes, -1)).all()


def test_all_invalid_and_extra_columns(spark):
    frame = grid_frame(spark, np.ones((2, 2), int), np.zeros((2, 2), bool)).withColumn("note", F.lit("x"))
    out = P.smooth_patches(frame).collect()
    assert len(out) == 4 and {row["class_id"] for row in out} == {-1} and {row["note"] for row in out} == {"x"}


def table_model(classes, names, rows):
    """Linear model whose class k wins when feature k is the only one set."""
    return C.DenseModel(list(names), [0.0] * len(names), [1.0] * len(names), [(rows, [0.0] * len(classes))], list(classes))


PIXEL = "scene_id string, row int, col int, Reflectance_B03 double, Reflectance_B04 double, Reflectance_B05 double, Reflectance_B08 double"


def test_classify_center_of_nine(spark):
    """A seagrass pixel inside class 2 takes class 2 and loses its cover; positive NDWI is undone the same way."""
    for green in (1.0, 4.0):  # without and with positive NDWI in the centre
        rows = [("s", r, c, green if (r, c) == (1, 1) else 1.0, 1.0, 9.0 if (r, c) == (1, 1) else 0.0, 3.0) for r in range(3) for c in range(3)]
        model = table_model([2, 4], ["Reflectance_B05", "Reflectance_B04"], [[-1.0, 1.0], [1.0, 0.0]])
        out = {(row["row"], row["col"]): row for row in classify_pixels(spark.createDataFrame(rows, PIXEL), model).collect()}
        assert out[1, 1]["out_class"] == 2 and out[1, 1]["seagrass_cover"] == -1.0
        raw = {(row["row"], row["col"]): row for row in classify_pixels(spark.createDataFrame(rows, PIXEL), model, smoothing=False).collect()}
        assert raw[1, 1]["out_class"] == (4 if green == 1.0 else 8)
        assert raw[1, 1]["ndvi"] == 0.5 and raw[1, 1]["seagrass_cover"] == (pytest.approx(172.06 * 0.5 - 22.18) if green == 1.0 else -1.0)


def test_specialist_replaces_class_and_probability(spark):
    names = ["Reflectance_B03", "Reflectance_B04", "Reflectance_B05", "Reflectance_B08"]
    rows = [("s", 0, 0, 0.0, 1.0, 0.0, 2.0), ("s", 0, 1, 0.0, 0.0, 1.0, 2.0), ("s", 0, 2, 1.0, 0.0, 0.0, 2.0), ("s", 0, 3, None, 0.0, 0.0, 2.0)]
    main = table_model([4, 5, 2], names, [[0.0, 9.0, 0, 0], [0.0, 0, 9.0, 0], [9.0, 0, 0, 0]])
    special = table_model([4, 5], names, [[0.0, 0.0, 3.0, 0], [0.0, 3.0, 0, 0]])
    out = classify_pixels(spark.createDataFrame(rows, PIXEL), main, special, smoothing=False).orderBy("col").collect()
    assert [row["out_class"] for row in out] == [5, 4, 2, -1]
    assert out[0]["class_prob"] == pytest.approx(1 / (1 + np.exp(-3))) and out[2]["class_prob"] > 0.99
    assert out[3]["class_prob"] == -1.0 and out[3]["ndvi"] is None


def test_missing_specialist_bands_keep_main_result(spark):
    names = ["Reflectance_B03", "Reflectance_B04"]
    rows = spark.createDataFrame([("s", 0, 0, 1.0, 0.0, 3.0)], "scene_id string, row int, col int, Reflectance_B03 double, Reflectance_B04 double, Reflectance_B08 double")
    main = table_model([4, 2], names, [[1.0, 0.0], [0.0, 1.0]])
    special = table_model([4, 5], list(S.SPECIALIST_FEATURES), [[0.0] * 10, [1.0] * 10])
    with pytest.warns(UserWarning, match="specialist"):
        assert classify_pixels(rows, main, special, smoothing=False).first()["out_class"] == 4


def test_debug_keeps_all_layers(spark):
    rows = spark.createDataFrame([("s", 0, 0, 1.0, 0.0, 1.0, 3.0)], PIXEL)
    out = classify_pixels(rows, table_model([4, 2], ["Reflectance_B03", "Reflectance_B04"], [[1.0, 0.0], [0.0, 1.0]]), debug=True)
    assert {"Reflectance_B05", "NDWI", "SPC", "out_class", "class_prob", "seagrass_cover", "ndvi"} <= set(out.columns)


def test_legend(spark):
    out = Q.with_legend(spark.createDataFrame([(8,), (4,), (None,)], "class_id int")).orderBy("class_id").collect()
    assert [row["class_name"] for row in out] == [None, "Magnoliopsida", "Water"]
