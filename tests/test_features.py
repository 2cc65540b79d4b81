import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shorepix import schema as S
from shorepix.operators import features as X
from shorepix.operators import raster as G

BANDS4 = "Reflectance_B02 double, Reflectance_B03 double, Reflectance_B04 double, Reflectance_B08 double"


def test_infer_mode_ignores_order():
    for mode in S.MODES:
        assert S.infer_mode(reversed(S.MODE_FEATURES[mode])) == mode
    with pytest.raises(ValueError, match="unsupported input features: Foo"):
        S.infer_mode(["NDVI", "Foo"])
    assert [len(S.MODE_FEATURES[mode]) for mode in S.MODES] == [10, 26]
    assert S.resolve_mode(" High-Spatial accuracy ") == S.SPATIAL


def test_spatial_features_overwrite_stale_columns(spark):
    row = spark.createDataFrame([("Water", 10.0, 1.0, 2.0, 3.0, 5.0, 999.0, 999.0)],
                                f"True_Class string, Reflectance_B01 double, {BANDS4}, Reflectance_Stan_B02 double, NDVI double")
    out = X.training_table(row, S.SPATIAL)
    assert out.columns == ["True_Class", *S.MODE_FEATURES[S.SPATIAL]]
    values = out.first()
    assert [values[S.stan_name(b)] for b in ("B02", "B03", "B04", "B08")] == [0.0, 0.25, 0.5, 1.0]
    assert values["NDVI"] == 0.25 and values["NDWI"] == pytest.approx(-3 / 7)


def test_spectral_mode_selects_in_order(spark):
    names = list(S.MODE_FEATURES[S.SPECTRAL])
    row = spark.createDataFrame([("Water", *map(float, range(1, 27)), 0.0)], ["True_Class", *names, "extra"])
    assert X.training_table(row).columns == ["True_Class", *names]
    with pytest.raises(ValueError, match="spectral-mode inputs.* is missing required columns: NDWI"):
        X.training_table(row.drop("NDWI"))


def test_missing_raw_column_is_named(spark):
    row = spark.createDataFrame([("Water", 1.0, 2.0, 3.0)], "True_Class string, Reflectance_B02 double, Reflectance_B03 double, Reflectance_B04 double")
    with pytest.raises(ValueError) as problem:
        X.training_table(row, S.SPATIAL)
    assert str(problem.value) == "Training data (spatial-mode raw inputs) is missing required columns: Reflectance_B08"


def test_missing_list_is_shortened():
    assert S.shorten([str(i) for i in range(14)]).endswith("11, +2 more")


def test_null_and_constant_rows(spark):
    rows = spark.createDataFrame([(2.0, None, 4.0, 8.0), (3.0, 3.0, 3.0, 3.0), (None, None, None, None), (float("nan"), 1.0, 3.0, 0.0)], BANDS4)
    out = X.with_feature_indices(X.with_standardised(rows, [S.raw_name(b) for b in ("B02", "B03", "B04", "B08")])).collect()
    assert out[0]["Reflectance_Stan_B03"] is None and out[0]["NDWI"] is None and out[0]["Reflectance_Stan_B08"] == 1.0
    assert [out[1][S.stan_name(b)] for b in ("B02", "B03", "B04", "B08")] == [0.0] * 4
    assert [out[2][S.stan_name(b)] for b in ("B02", "B03", "B04", "B08")] == [0.0] * 4 and out[2]["NDVI"] is None
    assert out[3]["Reflectance_Stan_B02"] is None and out[3]["Reflectance_Stan_B04"] == 1.0


def test_zero_denominator_differs_between_features_and_layers(spark):
    row = spark.createDataFrame([(1.0, 0.0, 0.0, 0.0)], BANDS4)
    assert X.with_feature_indices(row).first()["NDVI"] == 0.0
    layers = X.with_scene_indices(row).first()
    assert layers["NDVI"] is None and layers["SPC"] is None


def test_sequence_table_and_groups(spark):
    row = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, 77.0)], f"{BANDS4}, Reflectance_Stan_B02 double")
    values = X.sequence_table(row, S.SPATIAL, context="Training data").first()
    assert list(values)[:4] == [1.0, 2.0, 3.0, 4.0]
    assert list(values)[4:] == pytest.approx([0, 1 / 3, 2 / 3, 1])
    assert S.sequence_groups(S.SPATIAL, False) == [["Reflectance_B02", "Reflectance_B03", "Reflectance_B04", "Reflectance_B08"]]
    with pytest.raises(ValueError, match="unsupported sequence feature 'NDVI'"):
        X.sequence_table(row, S.SPATIAL, features=["NDVI"], context="Training data")


def test_specialist_features(spark):
    row = spark.createDataFrame([(2.0, 4.0, 5.0, 8.0)], "Reflectance_B03 double, Reflectance_B04 double, Reflectance_B05 double, Reflectance_B08 double")
    values = X.specialist_features(row, context="x").first()
    assert [values[S.stan_name(b)] for b in S.SPECIALIST_BANDS] == pytest.approx([0, 2 / 6, 3 / 6, 1])
    assert values["NDVI"] == pytest.approx(4 / 12) and values["NDWI"] == pytest.approx(-6 / 10)


def test_text_numbers(spark):
    rows = spark.createDataFrame([("1.5",), (" 2e1 ",), ("nan",), ("x",), ("1.0f",), ("-inf",), (None,), ("",)], "v string")
    got = [row["v"] for row in X.coerce_numeric(rows, ["v"]).collect()]
    assert got == [1.5, 20.0, None, None, None, -math.inf, None, None]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(*[st.one_of(st.none(), st.floats(-1e6, 1e6))] * 4), min_size=1, max_size=20))
def test_standardised_range(spark, rows):
    names = [S.raw_name(b) for b in ("B02", "B03", "B04", "B08")]
    frame = spark.createDataFrame(rows, BANDS4)
    for row in X.with_standardised(frame, names).collect():
        raw = [row[n] for n in names]
        stan = [row[S.stan_name(n.split("_")[1])] for n in names]
        known = [v for v in raw if v is not None]
        if not known or max(known) - min(known) <= 0:
            assert stan == [0.0] * 4
        else:
            assert [v is None for v in stan] == [v is None for v in raw]
            assert min(v for v in stan if v is not None) == 0.0 and max(v for v in stan if v is not None) == pytest.approx(1.0)


def test_stack_reads_bands_by_position(spark):
    stack = spark.createDataFrame([("s", r, c, [float(i) for i in range(1, 13)]) for r in range(3) for c in range(4)],
                                  "scene_id string, row int, col int, values array<double>")
    wide = G.stack_to_wide(stack, G.PIXEL)
    assert {(row["Reflectance_B02"], row["Reflectance_B08"]) for row in wide.collect()} == {(2.0, 8.0)}
    assert G.stack_to_bands(stack, G.PIXEL).where("band = 'B12'").select("value").distinct().collect()[0][0] == 12.0
    with pytest.raises(Exception, match="exactly 12 bands"):
        G.stack_to_wide(stack.withColumn("values", F.slice("values", 1, 3)), G.PIXEL).collect()


def test_statistics_and_medians(spark):
    from shorepix.operators.ranking import exact_medians

    rows = spark.createDataFrame([(float(i), None if i % 3 else float(i % 7)) for i in range(1000)] + [(float("nan"), None)], "a double, b double")
    expected = {"a": 499.5, "b": sorted(float(i % 7) for i in range(0, 1000, 3))[167 - 1:168]}
    got = exact_medians(rows, ["a", "b"])
    assert got["a"] == expected["a"] and got["b"] == sum(expected["b"]) / len(expected["b"])
    # One value may fill most of a column.
    ties = spark.createDataFrame([(1.0,)] * 300 + [(float(i),) for i in range(2, 90)], "a double")
    assert exact_medians(ties, ["a"]) == {"a": 1.0}
    stats = {row["feature"]: row for row in X.sequence_statistics(spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "x double, y double"), ["x", "y"]).collect()}
    assert stats["x"]["mean"] == pytest.approx(4 / 3) and stats["y"]["std"] == 1.0


def test_medians_of_all_kinds_of_columns(spark):
    """Radix selection against sorting: signs, infinities, tiny and huge values, ties, gaps, one value, none."""
    import random
    import statistics

    from shorepix.operators.ranking import exact_medians

    rng = random.Random(3)
    columns = {
        "mixed": [rng.choice((-1, 1)) * rng.random() * 10.0 ** rng.randrange(-300, 300) for _ in range(501)],
        "even": [rng.uniform(-1, 1) for _ in range(500)], "signs": [-1.0] * 250 + [1.0] * 250, "zero": [-0.0] * 100 + [0.0] * 101,
        "edge": [-math.inf, -1.0, 5e-324, math.inf], "steps": [float(k % 3) for k in range(400)], "one": [7.25], "none": [],
        "close": [1.0 + k * 2 ** -52 for k in range(301)],
    }
    size = max(map(len, columns.values())) + 3
    padded = {name: values + [rng.choice((None, math.nan)) for _ in range(size - len(values))] for name, values in columns.items()}
    rows = list(zip(*[rng.sample(values, size) for values in padded.values()], strict=True))
    frame = spark.createDataFrame(rows, ", ".join(f"{name} double" for name in columns)).repartition(4)
    got = exact_medians(frame, list(columns))
    assert got == {name: statistics.median(values) if values else None for name, values in columns.items()}
    assert exact_medians(frame.limit(0), ["one"]) == {"one": None}
