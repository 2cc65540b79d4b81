"""Train, save, load, classify and validate: a model's weights give what its pipeline gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shorepix import schema as S
from shorepix.operators import features as X
from shorepix.operators import registry as Y
from shorepix.operators import scoring as C
from shorepix.plans import train as T
from shorepix.plans.classify import classify_pixels
from shorepix.plans.validate import predict_labels, validate

RAW = [S.raw_name(band) for band in S.MODEL_BANDS[S.SPATIAL]]
EXTRA = S.raw_name("B05")


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(300):
        kind = k % 3
        bands = rng.uniform(0.0, 0.3, 5) + np.array([[0, .5, 0, .9, .4], [.6, 0, .1, 0, 0], [0, 0, .8, .3, .7]][kind])
        rows.append((k, ["Magnoliopsida", "Water", "MPB"][kind], *map(float, bands)))
    return spark.createDataFrame(rows, f"row_id bigint, True_Class string, {', '.join(n + ' double' for n in [*RAW, EXTRA])}")


def _close(a, b):
    return np.allclose(np.array([r["probs"] for r in a]), np.array([r["probs"] for r in b]), atol=1e-6)


def test_spatial_model_from_training_to_validation(spark, labelled, tmp_path):
    trained = T.train_dense(labelled, S.SPATIAL, epochs=30, hidden=(8, 5), seed=3)
    special = T.train_specialist(labelled)
    assert trained.vocabulary == ["MPB", "Magnoliopsida", "Water"] and trained.class_ids == [1, 2, 3]
    assert special.vocabulary == ["Magnoliopsida", "Microphytobenthos"] and special.class_ids == [4, 5]
    path = str(tmp_path / "models")
    assert Y.save_model(spark, path, "main", trained, "europe") == 1
    assert Y.save_model(spark, path, "second", special, "europe", role=S.SPECIALIST_ROLE) == 1
    stored = Y.read_models(spark, path)
    loaded = Y.load_models(stored)
    assert set(loaded) == {"main", "second"} and loaded["main"] == trained.to_model() and loaded["second"] == special.to_model()
    assert [r["specialist_name"] for r in Y.with_specialist(Y.complete_metadata(stored)).collect()] == ["second"]
    inputs = X.prepare_features(labelled, S.SPATIAL, context="t", carry=["row_id"]).orderBy("row_id")
    assert _close(trained.score(inputs).collect(), C.score_dense(inputs, loaded["main"]).collect())
    two = X.specialist_features(labelled, context="t", carry=["row_id"]).orderBy("row_id")
    assert _close(special.score(two).collect(), C.score_dense(two, loaded["second"]).collect())
    # Classify and validate take the trained models as well as the loaded ones.
    pixels = labelled.select(F.lit("s").alias("scene_id"), F.col("row_id").cast("int").alias("row"), F.lit(0).alias("col"), *RAW, EXTRA)
    given = classify_pixels(pixels, trained, special, smoothing=False).orderBy("row").collect()
    again = classify_pixels(pixels, loaded["main"], loaded["second"], smoothing=False).orderBy("row").collect()
    assert given == again and {r["out_class"] for r in given} <= set(range(1, 9))
    found = predict_labels(labelled, trained, specialist=special).orderBy("row_id").collect()
    assert found == predict_labels(labelled, loaded["main"], specialist=loaded["second"]).orderBy("row_id").collect()
    measured = validate(labelled, "True_Class", loaded["main"])
    assert measured.metrics.first()["Overall_Accuracy"] > 0.9 and trained.accuracy > 0.9


def test_missing_values_are_inputs_of_their_own(spark):
    """Where a band is missing decides the class here, and nothing else does."""
    names = S.MODE_FEATURES[S.SPECTRAL]
    rng = np.random.default_rng(2)
    rows = []
    for k in range(400):
        values = [float(v) for v in rng.uniform(0, 1, len(names))]
        if k % 2:
            values[2] = None if k % 4 == 1 else float("nan")
        rows.append((f"c{k % 2}", *values))
    frame = spark.createDataFrame(rows, f"True_Class string, {', '.join(n + ' double' for n in names)}")
    trained = T.train_dense(frame, S.SPECTRAL, epochs=40, hidden=(6,), seed=1)
    model = trained.to_model()
    assert trained.flags == [names[2]] == model.flags and len(model.mean) == len(names) + 1 and trained.accuracy > 0.95
    scored = C.score_dense(frame, model).collect()
    assert _close(trained.score(frame).collect(), scored)
    assert all((r["probs"][1] > 0.5) == (r["True_Class"] == "c1") for r in scored)
    assert C.DenseModel.from_json(model.to_json()) == model
    with pytest.raises(ValueError, match="do not fit"):
        C.DenseModel(["a"], [0.0], [1.0], [([[1.0, 1.0]], [0.0])], [1], flags=["a"])


def test_constant_inputs_and_versions(spark, tmp_path):
    rows = [(f"c{k % 2}", float(k % 2), 1.0, float(k), 0.5) for k in range(60)]
    frame = spark.createDataFrame(rows, f"True_Class string, {', '.join(n + ' double' for n in RAW)}")
    frame = X.with_feature_indices(X.with_standardised(frame.withColumn(RAW[2], F.lit(3.0)), RAW))
    trained = T.train_dense(frame, S.SPATIAL, epochs=15, hidden=(4,))
    inputs = X.prepare_features(frame.withColumn(RAW[2], F.lit(9.0)), S.SPATIAL, context="t")
    assert _close(trained.score(inputs).collect(), C.score_dense(inputs, trained.to_model()).collect())
    path = str(tmp_path / "models")
    other = C.DenseModel(list(S.MODE_FEATURES[S.SPATIAL]), [0.0] * 10, [1.0] * 10, [([[1.0] * 10, [0.0] * 10], [0.0, 0.0])], [1, 2], ["a", "b"])
    assert [Y.save_model(spark, path, "m", model) for model in (trained, other, other)] == [1, 2, 3]
    models = Y.read_models(spark, path)
    assert Y.load_models(models)["m"] == other and Y.load_models(models, ["m"], version=1)["m"] == trained.to_model()
    with pytest.raises(ValueError, match="no such model"):
        Y.load_models(models, ["m", "n"])


def _sequence(groups, norm, seed=0):
    rng = np.random.default_rng(seed)
    draw = lambda *size: rng.normal(size=size).tolist()
    return C.SequenceModel(groups, norm, (draw(4, len(groups), 3), draw(4)), (draw(6, 4, 3), draw(6)), (draw(5, 6), draw(5)), (draw(3, 5), draw(3)), [1, 2, 3], ["a", "b", "c"])


def test_sequence_model_round_trip_and_statistics(spark, tmp_path):
    groups = S.sequence_groups(S.SPATIAL)
    norm = {"mean": [[1.0, 2.0, 3.0, 4.0], [0.1, 0.2, 0.3, 0.4]], "std": [[0.5] * 4, [0.2] * 4]}
    model, path = _sequence(groups, norm), str(tmp_path / "models")
    Y.save_model(spark, path, "cnn", model)
    row = Y.complete_metadata(Y.read_models(spark, path)).first()
    assert (row["model_family"], row["feature_mode"], row["uses_standardised"], row["problem"]) == (Y.SEQUENCE, S.SPATIAL, True, None)
    assert Y.load_models(Y.read_models(spark, path))["cnn"] == model
    # Statistics in one row serve both channels; a single channel has only one row; other lengths do not fit.
    flat = Y.model_row("flat", model) | {"norm_mean": [[*norm["mean"][0], *norm["mean"][1]]], "norm_std": [[*norm["std"][0], *norm["std"][1]]]}
    mixed = Y.model_row("mixed", model) | {"norm_mean": flat["norm_mean"]}
    raw = Y.model_row("raw", _sequence(groups[:1], {"mean": [[0.1, 0.2, 0.3, 0.4]], "std": [[1.0] * 4]})) | {"channel_groups": None}
    short = Y.model_row("short", model) | {"norm_std": [[0.5] * 7]}
    table = spark.createDataFrame([flat, mixed, raw, short], S.MODEL_SCHEMA)
    done = {r["model_name"]: r for r in Y.complete_metadata(table).collect()}
    assert done["flat"]["norm_mean"] == norm["mean"] and done["flat"]["norm_std"] == norm["std"] and done["mixed"]["problem"] is None
    assert done["raw"]["channel_groups"] == groups[:1] and not done["raw"]["uses_standardised"] and done["raw"]["norm_mean"] == [[0.1, 0.2, 0.3, 0.4]]
    assert done["short"]["problem"] == "normalization does not fit"
    assert Y.load_models(table, ["flat"])["flat"] == model
    with pytest.raises(ValueError, match="'short' cannot be used: normalization does not fit"):
        Y.load_models(table, ["short"])
    with pytest.raises(ValueError, match="no weights"):
        Y.load_models(spark.createDataFrame([Y.model_row("bare", model) | {"layers": None}], S.MODEL_SCHEMA))


def test_every_row_by_its_own_model(spark):
    groups = S.sequence_groups(S.SPATIAL)
    rows = [(k, ["dense", "cnn", "none", None][k % 4], *[None if k % 5 == 0 and j == 1 else float(j + k % 7) for j in range(4)]) for k in range(60)]
    frame = spark.createDataFrame(rows, f"i int, model string, {', '.join(n + ' double' for n in groups[0])}")
    table = X.sequence_table(frame, S.SPATIAL, context="t", carry=["i", "model"]).orderBy("i")
    norm = {"mean": [[0.5] * 4, [None, float("nan"), 0.0, 0.0]], "std": [[2.0] * 4, [0.0, 1.0, 1.0, float("inf")]]}
    cnn = _sequence(groups, norm)
    dense = C.DenseModel(groups[0][:3], [1.0] * 4, [2.0] * 4, [([[0.3, -0.2, 0.1, 0.5], [0.1, 0.2, -0.4, 0.0]], [0.0, 0.1])], [1, 2], ["a", "b"], [1.0, 2.0, 3.0], [groups[0][1]])
    got = C.score_by_model(table, {"dense": dense, "cnn": cnn}, "model").collect()
    one, two = C.score_dense(table, dense).collect(), C.score_sequence(table, cnn).collect()
    for mine, a, b in zip(got, one, two, strict=True):
        want = {"dense": a["probs"], "cnn": b["probs"]}.get(mine["model"])
        assert mine["probs"] is None if want is None else np.allclose(mine["probs"], want)
    assert C.score_by_model(table.limit(0), {"dense": dense}, "model").count() == 0


def test_training_after_a_session_has_observed_metrics(spark, labelled):
    from pyspark.sql import Observation

    seen = Observation("any")
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).count()
    special = T.train_specialist(labelled, epochs=3)
    assert seen.get["n"] == 3 and special.score(X.specialist_features(labelled, context="t")).count() == 300
