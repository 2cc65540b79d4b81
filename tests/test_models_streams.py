import json
import os
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from shorepix import schema as S
from shorepix.operators import features as X
from shorepix.operators import scoring as C
from shorepix.plans import train as T
from shorepix.plans.classify import classify_pixels
from shorepix.plans.validate import predict_labels, validate
from shorepix.streaming import ingest as I


def dense(features, hidden, classes, seed=0):
    rng = np.random.default_rng(seed)
    layers, width = [], len(features)
    for size in (*hidden, classes):
        layers.append((rng.normal(size=(size, width)).tolist(), rng.normal(size=size).tolist()))
        width = size
    return C.DenseModel(list(features), rng.normal(size=len(features)).tolist(), [2.0] * len(features), layers, list(range(1, classes + 1)), [f"c{i}" for i in range(classes)])


def by_hand(model, rows):
    x = (np.nan_to_num(np.array(rows, dtype=float)) - model.mean) / model.std
    for i, (weights, bias) in enumerate(model.layers):
        x = x @ np.array(weights).T + bias
        x = np.maximum(x, 0) if i < len(model.layers) - 1 else x
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@pytest.mark.parametrize("hidden", [(), (200, 100)])
def test_dense_scores(spark, hidden):
    model = dense(["a", "b", "c"], hidden, 4)
    rows = [(0.1 * i, 2.0 - i, None if i % 4 == 0 else 0.3) for i in range(50)]
    frame = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "i int, a double, b double, c double")
    got = C.score_dense(frame, model).orderBy("i").collect()
    assert np.allclose([row["probs"] for row in got], by_hand(model, [[v or 0.0 for v in row] for row in rows]))
    assert C.DenseModel.from_json(model.to_json()) == model
    with pytest.raises(ValueError, match="missing required columns: c"):
        C.score_dense(frame.drop("c"), model)
    labels = C.score_dense(frame, model).select(C.label_of(F.col("probs"), ["only"])).distinct().collect()
    assert {row[0] for row in labels} <= {"only", "1", "2", "3"}


def test_first_maximum_wins(spark):
    row = spark.createDataFrame([([0.4, 0.4, 0.2],)], "probs array<double>")
    assert row.select(C.class_of(F.col("probs"), [7, 8, 9])).first()[0] == 7


def test_full_size_network_has_the_documented_weights():
    weights = 26 * 200 + 200 * 100 + 100 * 9 + 9  # hidden layers without bias, batch normalization on three levels
    assert weights + 2 * 26 + 2 * 200 + 2 * 100 == 26_761


def test_later_filters_do_not_copy_the_network(spark):
    frame = spark.createDataFrame([("s", 0, 0, 1.0, 2.0, 3.0)], "scene_id string, row int, col int, Reflectance_B03 double, Reflectance_B04 double, Reflectance_B08 double")
    out = classify_pixels(frame, dense(["Reflectance_B03", "Reflectance_B04"], (8,), 5), smoothing=False).where("out_class = 4 AND scene_id = 's'")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and out.count() >= 0


def sequence_by_hand(model, raw, stan):
    out = []
    for r, s in zip(raw, stan):
        x = (np.array([r, s][: len(model.groups)]) - model.norm["mean"]) / np.array(model.norm["std"])
        for kernel, bias in (model.conv1, model.conv2):
            wide, result = np.pad(x, ((0, 0), (1, 1))), []
            for o in range(len(kernel)):
                line = [bias[o] + sum(kernel[o][c][k] * wide[c][i + k] for c in range(len(x)) for k in range(3)) for i in range(x.shape[1])]
                result.append(np.maximum(line, 0))
            x = np.array(result)
        hidden = np.maximum(np.array(model.dense1[0]) @ x.mean(1) + model.dense1[1], 0)
        z = np.array(model.dense2[0]) @ hidden + model.dense2[1]
        out.append(np.exp(z - z.max()) / np.exp(z - z.max()).sum())
    return np.array(out)


def test_sequence_scores(spark):
    rng = np.random.default_rng(1)
    groups = S.sequence_groups(S.SPATIAL)
    hidden, deeper, wide = C.SequenceModel.widths(4)
    assert (hidden, deeper, wide) == (16, 32, 32) and C.SequenceModel.widths(12) == (32, 64, 32)
    model = C.SequenceModel(groups, {"mean": [[1.0] * 4, [0.5] * 4], "std": [[2.0] * 4, [1.0] * 4]},
                            (rng.normal(size=(hidden, 2, 3)).tolist(), rng.normal(size=hidden).tolist()),
                            (rng.normal(size=(deeper, hidden, 3)).tolist(), rng.normal(size=deeper).tolist()),
                            (rng.normal(size=(wide, deeper)).tolist(), rng.normal(size=wide).tolist()),
                            (rng.normal(size=(3, wide)).tolist(), rng.normal(size=3).tolist()), [1, 2, 3])
    raw = [[1.0, 2.0, 3.0, 4.0], [5.0, 1.0, 0.5, 2.0]]
    frame = spark.createDataFrame([(i, *row) for i, row in enumerate(raw)], ["i", *[S.raw_name(b) for b in S.SEQUENCE_BANDS[S.SPATIAL]]])
    table = X.sequence_table(frame, S.SPATIAL, context="x", carry=["i"])
    got = np.array([row["probs"] for row in C.score_sequence(table, model).orderBy("i").collect()])
    stan = [[(v - min(r)) / (max(r) - min(r)) for v in r] for r in raw]
    assert got.shape == (2, 3) and np.allclose(got, sequence_by_hand(model, raw, stan)) and np.allclose(got.sum(1), 1)
    pixels = frame.selectExpr("'s' scene_id", "cast(i as int) row", "0 col", *[f"`{S.raw_name(b)}`" for b in S.SEQUENCE_BANDS[S.SPATIAL]])
    assert classify_pixels(pixels, model, smoothing=False).count() == 2
    with pytest.raises(ValueError, match="do not match"):
        C.SequenceModel(groups, {"mean": [[1.0] * 4], "std": [[1.0] * 4]}, model.conv1, model.conv2, model.dense1, model.dense2, [1, 2, 3])


def test_batch_norm_folding():
    kernel, bias = C.fold_batch_norm([[[1.0, 2.0, 3.0]]], [0.5], [2.0], [0.1], [0.3], [4.0], epsilon=0.0)
    assert kernel == [[[1.0, 2.0, 3.0]]] and bias == pytest.approx([0.3])


def test_specialist_training_table(spark):
    row = (2.0, 4.0, 5.0, 8.0)
    frame = spark.createDataFrame([("Magno", *row), ("Magnoliopsida", *row), ("MPB", *row), ("Water", *row)],
                                  "True_Class string, Reflectance_B03 double, Reflectance_B04 double, Reflectance_B05 double, Reflectance_B08 double")
    assert sorted(r["True_Class"] for r in T.specialist_training_table(frame).collect()) == ["Magnoliopsida", "Microphytobenthos"]


def test_training_separable_classes(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        low = i % 2 == 0
        rows.append(("seagrass" if low else "diatom", *(rng.normal(1.0 if low else 4.0, 0.2, 3)), float(rng.normal(6, 0.2)), None if i % 50 == 0 else float(rng.normal(2, 0.2))))
    columns = "True_Class string, Reflectance_B03 double, Reflectance_B04 double, Reflectance_B05 double, Reflectance_B08 double, Reflectance_B02 double"
    frame = spark.createDataFrame([(r[0], *map(lambda v: None if v is None else float(v), r[1:])) for r in rows], columns)
    special = T.train_specialist(frame)
    assert special.accuracy > 0.95 and special.vocabulary == ["Magnoliopsida", "Microphytobenthos"]
    model = T.train_dense(frame, S.SPATIAL, epochs=30, hidden=(6,))
    assert model.accuracy > 0.9 and model.rows == 400
    scored = model.score(X.training_table(frame, S.SPATIAL))
    assert scored.where(F.abs(F.aggregate("probs", F.lit(0.0), lambda a, b: a + b) - 1) > 1e-9).count() == 0
    for bad in ({"epochs": 0}, {"valid_share": 1.0}, {"batch_size": 0}):
        with pytest.raises(ValueError):
            T.train_dense(frame, S.SPATIAL, **bad)


def test_validation_with_specialist(spark):
    names = ["Reflectance_B02", "Reflectance_B03", "Reflectance_B04", "Reflectance_B08"]
    features = list(S.MODE_FEATURES[S.SPATIAL])
    pick = [[0.0] * 10 for _ in range(3)]
    pick[0][0], pick[1][1], pick[2][2] = 9.0, 9.0, 9.0  # the largest of three raw bands decides
    main = C.DenseModel(features, [0.0] * 10, [1.0] * 10, [(pick, [0.0] * 3)], [1, 2, 3])
    special = C.DenseModel(list(S.SPECIALIST_FEATURES), [0.0] * 10, [1.0] * 10, [([[0.0] * 10, [0, 0, 1.0] + [0.0] * 7], [0.0, 0.0])], [4, 5], ["Magnoliopsida", "Microphytobenthos"])
    rows = spark.createDataFrame([(0, "Seagrass", 5.0, 1.0, 0.0, 1.0, 3.0), (1, "Water", 0.0, 5.0, 1.0, 1.0, 1.0), (2, "MPB", 0.0, 1.0, 5.0, 1.0, 0.0)],
                                 f"row_id bigint, Label_Char string, {', '.join(n + ' double' for n in names)}, Reflectance_B05 double")
    vocabulary = ["Magnoliopsida", "Water", "Bacillariophyceae"]
    plain = validate(rows, "Label_Char", main, vocabulary)
    assert [r["Predicted_Class"] for r in plain.predictions.orderBy("row_id").collect()] == ["Seagrass", "Water", "MPB"]
    assert plain.metrics.first()["Overall_Accuracy"] == 1.0
    refined = validate(rows, "Label_Char", main, vocabulary, special)
    assert [r["Predicted_Class"] for r in refined.predictions.orderBy("row_id").collect()] == ["MPB", "Water", "Seagrass"]
    assert refined.predictions.orderBy("row_id").first()["Predicted_Confidence"] == pytest.approx(1 / (1 + np.exp(-3)))
    # The specialist as main model, and without one of its bands.
    alone = predict_labels(rows, special, special.labels).orderBy("row_id").collect()
    assert [r["raw_prediction"] for r in alone] == ["Microphytobenthos", "Microphytobenthos", "Magnoliopsida"]
    with pytest.warns(UserWarning, match="Reflectance_B05"):
        kept = predict_labels(rows.drop("Reflectance_B05"), main, vocabulary, special)
    assert [r["raw_prediction"] for r in kept.orderBy("row_id").collect()] == vocabulary


def test_predictions_keep_the_input_rows(spark):
    bands = [S.raw_name(band) for band in S.SPECIALIST_BANDS]
    missing = S.raw_name("B05")
    rows = spark.createDataFrame([(0, *[None if name == missing else 2.0 + i for i, name in enumerate(bands)], 0.9), (1, *[1.0] * len(bands), None)],
                                 f"row_id bigint, {', '.join(n + ' double' for n in bands)}, NDVI double")
    special = C.DenseModel(list(S.SPECIALIST_FEATURES), [0.0] * 10, [1.0] * 10, [([[0.1] * 10, [0.2, 0, 0.3] + [0.0] * 7], [0.0, 0.0])], [4, 5], ["Magnoliopsida", "Microphytobenthos"])
    length = len(bands)
    main = C.SequenceModel([bands], {"mean": [[0.0] * length], "std": [[1.0] * length]}, ([[[0.0, 1.0, 0.0]]], [0.0]), ([[[0.0, 1.0, 0.0]]], [0.0]),
                           ([[1.0]], [0.0]), ([[1.0], [0.0]], [1.0, 0.0]), [4, 5])
    found = predict_labels(rows, main, special.labels, special)
    assert [tuple(r[name] for name in rows.columns) for r in found.orderBy("row_id").collect()] == [tuple(r) for r in rows.orderBy("row_id").collect()]
    expected = predict_labels(rows, special, special.labels).orderBy("row_id").collect()
    assert [r["Predicted_Confidence"] for r in found.orderBy("row_id").collect()] == pytest.approx([r["Predicted_Confidence"] for r in expected])


PIXELS = "scene_id string, row int, col int, v double"


def write_scene(spark, folder, scene, value):
    spark.createDataFrame([(scene, 0, c, value) for c in range(3)], PIXELS).coalesce(1).write.mode("append").parquet(folder)


def test_incremental_ingest(spark, tmp_path):
    source, output, failed, state = (str(tmp_path / name) for name in ("in", "out", "failed", "state"))
    schema = spark.createDataFrame([], PIXELS).schema
    calls = []

    def process(rows):
        calls.append(1)
        return rows.withColumn("v", F.when(F.col("v") < 100, F.col("v") + 1).otherwise(F.raise_error(F.lit("unreadable")).cast("double")))

    def run():
        stream = I.scene_stream(spark, source, schema)
        problem = F.when(F.col("v").isNull(), "missing band")
        I.ingest_scenes(stream, process, output, failed, state, problem).awaitTermination()

    write_scene(spark, source, "a", 1.0)
    write_scene(spark, source, "b", None)
    run()
    assert {(r["scene_id"], r["v"]) for r in spark.read.parquet(output).collect()} == {("a", 2.0)}
    assert [tuple(r) for r in spark.read.parquet(failed).select("scene_id", "error").collect()] == [("b", "missing band")]
    seen = len(calls)
    run()
    assert len(calls) == seen  # nothing new
    write_scene(spark, source, "c", 5.0)
    write_scene(spark, source, "d", 500.0)
    run()
    assert {r["scene_id"] for r in spark.read.parquet(output).select("scene_id").distinct().collect()} == {"a", "c"}
    errors = {r["scene_id"]: r["error"] for r in spark.read.parquet(failed).collect()}
    assert set(errors) == {"b", "d"} and "unreadable" in errors["d"]


def test_streaming_duplicates_and_rollup(spark, tmp_path):
    folder = tmp_path / "scenes"
    folder.mkdir()
    rows = [("S1", "/z/S1.zip", "2024-01-01T00:00:00"), ("s1", "/y/s1.SAFE", "2024-01-01T00:01:00"), ("S2", "/z/S2.zip", "2024-01-02T00:00:00")]
    (folder / "a.json").write_text("\n".join(json.dumps({"scene_id": a, "path": b, "arrived_at": c}) for a, b, c in rows))
    stream = spark.readStream.schema("scene_id string, path string, arrived_at timestamp").json(str(folder))
    accepted, state = str(tmp_path / "accepted"), str(tmp_path / "state")
    I.first_scenes(stream, accepted, state).awaitTermination()
    assert sorted((r["scene_key"], r["path"]) for r in spark.read.parquet(accepted).collect()) == [("S1", "/y/s1.SAFE"), ("S2", "/z/S2.zip")]
    # A scene from long before is accepted, and a copy of a known one from long after is not.
    rows = [("S3", "/z/S3.zip", "2020-01-01T00:00:00"), ("s2", "/y/s2.SAFE", "2026-01-01T00:00:00")]
    (folder / "b.json").write_text("\n".join(json.dumps({"scene_id": a, "path": b, "arrived_at": c}) for a, b, c in rows))
    I.first_scenes(stream, accepted, state).awaitTermination()
    assert sorted((r["scene_key"], r["path"]) for r in spark.read.parquet(accepted).collect()) == [
        ("S1", "/y/s1.SAFE"), ("S2", "/z/S2.zip"), ("S3", "/z/S3.zip")]

    runs = tmp_path / "runs"
    runs.mkdir()
    (runs / "a.json").write_text('{"workflow":"apply","status":"success","duration_seconds":2.0}\n{bad\n{"workflow":"apply","status":"success","duration_seconds":3.0}\n')
    query = I.run_rollup(spark, str(runs)).writeStream.outputMode("complete").format("memory").queryName("rollup").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [tuple(r) for r in spark.table("rollup").collect()] == [("apply", "success", 2, 5.0)]


def test_finished_inputs_are_archived(spark, tmp_path):
    source, archive = tmp_path / "in", tmp_path / "Done"
    schema = spark.createDataFrame([], PIXELS).schema
    args = (lambda rows: rows, str(tmp_path / "out"), str(tmp_path / "failed"), str(tmp_path / "state"))
    for scene in ("a", "b"):
        write_scene(spark, str(source), scene, 1.0)
        I.ingest_scenes(I.scene_stream(spark, str(source), schema, archive=str(archive), files_per_batch=1), *args).awaitTermination()
    deadline = time.time() + 20
    while time.time() < deadline and not [f for _, _, files in os.walk(archive) for f in files if f.endswith(".parquet")]:
        time.sleep(0.5)
    assert [f for _, _, files in os.walk(archive) for f in files if f.endswith(".parquet")]


def test_training_query_trains_the_operators_own_size(spark, monkeypatch):
    import workload

    workload.load_all()
    made = []
    perceptron = T.MultilayerPerceptronClassifier
    monkeypatch.setattr(T, "MultilayerPerceptronClassifier", lambda **given: made.append(given) or perceptron(**given))
    assert workload.QUERIES["dense_training"](spark, "/root/testdata/sf0.001").count() > 0
    assert [(g["layers"][1:-1], g["maxIter"]) for g in made] == [([200, 100], 20)]


def test_hidden_layers_do_not_grow_with_the_batch():
    rng = np.random.default_rng(5)
    hidden, deeper, wide = C.SequenceModel.widths(12)
    groups = [[f"a{i}" for i in range(12)], [f"b{i}" for i in range(12)]]
    sequence = C.SequenceModel(groups, {"mean": [[0.0] * 12] * 2, "std": [[1.0] * 12] * 2},
                               (rng.normal(size=(hidden, 2, 3)).tolist(), rng.normal(size=hidden).tolist()),
                               (rng.normal(size=(deeper, hidden, 3)).tolist(), rng.normal(size=deeper).tolist()),
                               (rng.normal(size=(wide, deeper)).tolist(), rng.normal(size=wide).tolist()),
                               (rng.normal(size=(3, wide)).tolist(), rng.normal(size=3).tolist()), [1, 2, 3])
    flat = C.DenseModel(groups[0], [0.0] * 12, [1.0] * 12, [(rng.normal(size=(400, 12)).tolist(), [0.1] * 400), (rng.normal(size=(3, 400)).tolist(), [0.0] * 3)], [1, 2, 3])
    for model in (sequence, flat):
        network, x = model.network(), rng.normal(size=(10_000, len(model.inputs)))
        tracemalloc.start()
        found = network(x)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert found.shape == (10_000, 3) and peak < 20 << 20
        alone = np.concatenate([network(x[k:k + 1]) for k in (0, 255, 256, 5_000, 9_999)])
        assert np.allclose(found[[0, 255, 256, 5_000, 9_999]], alone)
