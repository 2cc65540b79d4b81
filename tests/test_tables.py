import random

import pytest
from pyspark.sql import functions as F

from shorepix import schema as S
from shorepix.operators import history as H
from shorepix.operators import lookup as J
from shorepix.operators import ranking as K
from shorepix.sources import runs as U
from shorepix.sources import tables as T


def test_csv_files_with_different_headers(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.csv").write_text("True_Class,x,y\nSand,1,2\n,,\n")
    (tmp_path / "sub" / "b.csv").write_text("y,True_Class,z\n4,Water,5\n")
    (tmp_path / "c.txt").write_text("ignored")
    rows = {row["True_Class"]: row for row in T.read_training(spark, str(tmp_path)).collect()}
    assert len(rows) == 2 and (rows["Water"]["y"], rows["Water"]["x"], rows["Water"]["z"]) == ("4", None, "5")
    both = T.read_csv_tables(spark, [str(tmp_path / "a.csv"), str(tmp_path / "a.csv"), str(tmp_path / "sub" / "b.csv")], ["True_Class", "y"])
    assert sorted(tuple(row) for row in both.collect()) == [("Sand", "2"), ("Water", "4")]
    (tmp_path / "d.csv").write_text("True_Class,x\n  ,3\n")
    with pytest.raises(ValueError, match="missing values in the True_Class"):
        T.read_training(spark, str(tmp_path))
    for source, text in (([], "At least one"), ("  ", "path is required"), (["x.txt"], "must be a CSV")):
        with pytest.raises(ValueError, match=text):
            T.training_files(source)


def test_validation_table(spark, tmp_path):
    path = tmp_path / "v.csv"
    path.write_text("Label_Char,NDVI\nSand,0.1\nWater,0.2\n")
    assert [row["Label_Char"] for row in T.read_validation(spark, str(path)).orderBy("row_id").collect()] == ["Sand", "Water"]
    with pytest.raises(ValueError, match="'Foo' was not found"):
        T.read_validation(spark, str(path), "Foo")
    path.write_text("Label_Char,NDVI\n")
    with pytest.raises(ValueError, match="empty"):
        T.read_validation(spark, str(path))
    assert T.report_names("/d/My Data.csv", "/m/Main.v1.bin")[1] == "My_Data__Main.v1__metrics.csv"


def test_band_table_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "bands")
    rows = [(s, b, r, c, float(c), float(r), 1.0) for s in ("s1", "s2") for b in ("B02", "B03") for r in range(4) for c in range(4)]
    spark.createDataFrame(rows, "scene_id string, band string, row int, col int, x double, y double, value double").write.partitionBy("scene_id", "band").parquet(path)
    df = T.read_bands(spark, path, ["s1"], ["B03"], (1, 1, 2, 2))
    assert df.count() == 4
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan or "PartitionFilters: [(scene_id" in plan or "scene_id" in plan.split("PartitionFilters")[1].split("]")[0]
    assert "GreaterThanOrEqual(x,1.0)" in plan


def test_grid_rerun_replaces_only_its_scenes(spark, tmp_path):
    path = str(tmp_path / "grid")
    make = lambda scene, value: spark.createDataFrame([(scene, 0, 0, value, 0.5, -1.0, None)], "scene_id string, row int, col int, out_class int, class_prob double, seagrass_cover double, ndvi double")
    T.write_grid(make("a", 1).union(make("b", 2)), path)
    T.write_grid(make("b", 3), path)
    assert {(row["scene_id"], row["out_class"]) for row in spark.read.parquet(path).collect()} == {("a", 1.0), ("b", 3.0)}
    T.write_chunks(spark.range(25).coalesce(1), str(tmp_path / "chunks"), 10)
    assert len(list((tmp_path / "chunks").glob("*.csv"))) == 3


def test_chunk_numbers(spark):
    keys = list(range(0, 2500, 1))
    random.Random(1).shuffle(keys)
    got = {row["k"]: row["chunk"] for row in K.number_chunks(spark.createDataFrame([(k,) for k in keys], "k bigint"), "k", 1000, width=300).collect()}
    assert got[0] == "0001" and got[999] == "0001" and got[1000] == "0002" and got[2499] == "0003"
    wide = K.number_chunks(spark.range(10_001), "id", 1, width=1000).agg(F.max(F.col("chunk").cast("int")), F.max(F.length("chunk"))).first()
    assert tuple(wide) == (10001, 5)


def test_exact_splits_with_a_hot_label(spark):
    rows = [("hot", i) for i in range(900)] + [("few", i) for i in range(5)] + [("two", i) for i in range(2)]
    frame = spark.createDataFrame(rows, "label string, k int")
    out = K.stratified_split(frame, "label", ["label", "k"], 0.3)
    sizes = {row["label"]: (row["n"], row["v"]) for row in out.groupBy("label").agg(F.count("*").alias("n"), F.count_if("is_valid").alias("v")).collect()}
    assert sizes == {"hot": (900, 270), "few": (5, 2), "two": (2, 1)}  # 1.5 rounds half to even
    assert out.exceptAll(K.stratified_split(frame.repartition(7), "label", ["label", "k"], 0.3)).count() == 0
    with pytest.raises(ValueError, match="at least two rows"):
        K.stratified_split(frame.unionByName(spark.createDataFrame([("one", 1)], "label string, k int")), "label", ["label", "k"])
    halves = K.random_split(frame, ["label", "k"], 0.3)
    assert (halves.count(), halves.where("is_valid").count()) == (907, 272)
    assert K.random_split(frame.limit(2), ["label", "k"], 0.3).where("is_valid").count() == 0


@pytest.mark.parametrize("max_rows", [1, 100_000])
def test_exact_splits_keep_a_hot_null_label(spark, monkeypatch, max_rows):
    attach = J.attach
    monkeypatch.setattr(K, "attach", lambda *a: attach(*a, max_rows=max_rows))
    rows = [(None, i) for i in range(900)] + [("few", i) for i in range(5)] + [("", i) for i in range(3)]
    frame = spark.createDataFrame(rows, "label string, k int")
    out = K.stratified_split(frame, "label", ["label", "k"], 0.3)
    sizes = {row["label"]: (row["n"], row["v"]) for row in out.groupBy("label").agg(F.count("*").alias("n"), F.count_if("is_valid").alias("v")).collect()}
    assert sizes == {None: (900, 270), "few": (5, 2), "": (3, 1)}
    assert out.columns == ["label", "k", "is_valid"] and out.drop("is_valid").exceptAll(frame).count() == 0


def test_salted_lookup_keeps_every_row(spark):
    big = spark.createDataFrame([("hot" if i % 3 == 0 else f"k{i}", i) for i in range(3000)], "key string, v int")
    small = big.groupBy("key").agg(F.max("v").alias("top"))
    joined = J.salted_lookup(big, small, ["key"])
    assert joined.count() == 3000 and joined.where("key = 'hot' AND top <> 2997").count() == 0
    assert J.salted_lookup(big, small.where("key <> 'hot'"), ["key"], "left").where("top IS NULL").count() == 1000
    for limit in (10, 100_000):
        assert J.attach(big, small, ["key"], max_rows=limit).where("top IS NOT NULL").count() == 3000


def test_override_predictions(spark):
    main = spark.createDataFrame([(1, 4, 0.5), (2, 5, 0.6), (3, 2, 0.94)], "id int, c int, p double")
    refined = spark.createDataFrame([(1, 5, 0.92), (2, 4, 0.88)], "id int, c int, p double")
    assert sorted(tuple(row) for row in J.override_predictions(main, refined, ["id"], ["c", "p"]).collect()) == [(1, 5, 0.92), (2, 4, 0.88), (3, 2, 0.94)]


def test_history_log(spark, tmp_path):
    path = str(tmp_path / "runs")
    run = H.new_run(spark, started_at="2026-03-12T15:45:45 ", workflow=" Apply", status="SUCCESS", duration_seconds=-3.0, mask_path="/m.shp",
                    details="Scenes=324; processed=130; note=a=b; processed=131", mask_extent_coords=[[36.1234567, -6.0], [37.0, -6.0], [37.0, -5.0], [36.0, -5.0], [0.0, 0.0]])
    U.append_run(run, path)
    (tmp_path / "runs" / "extra.json").write_text('{"started_at": "2026-03-13T00:00:00", "workflow": "apply", "duration_seconds": "x", "mask_path": "m", "location_name": "Cadiz"}\n[1]\n{bad\n\n"text"\n')
    rows = {row["started_at"]: row for row in U.read_runs(spark, path).collect()}
    assert set(rows) == {"2026-03-12T15:45:45", "2026-03-13T00:00:00"}
    first = rows["2026-03-12T15:45:45"]
    assert (first["workflow"], first["status"], first["duration_seconds"]) == ("apply", "success", 0.0)
    assert len(first["mask_extent_coords"]) == 4 and first["mask_extent_coords"][0] == [36.123457, -6.0]
    both = U.read_runs(spark, path).orderBy("started_at")
    checks = both.select(H.detail_number(F.col("details"), "Scenes"), H.details_map(F.col("details"))["processed"], H.detail_value(F.col("details"), "note"),
                         H.needs_location(), H.needs_extent(), H.run_key()).collect()
    assert list(checks[0])[:5] == [324, "131", "a=b", True, False] and list(checks[1])[3:5] == [True, True]
    assert checks[0][5] == "2026-03-12T15:45:45|apply||"
    U.rewrite_runs(spark, path, str(tmp_path / "kept"), keep=1)
    assert spark.read.json(str(tmp_path / "kept")).count() == 1
    assert H.recent_runs(both, 1).first()["started_at"] == "2026-03-13T00:00:00"


def test_run_outcomes(spark):
    rows = [((2, 1, 1, False), "partial"), ((0, 0, 2, False), "failed"), ((3, 4, 0, False), "partial"), ((0, 4, 0, False), "skipped"),
            ((3, 0, 0, False), "success"), ((0, 0, 0, False), "success"), ((3, 0, 0, True), "failed")]
    frame = spark.createDataFrame([row for row, _ in rows], "p int, s int, f int, a boolean")
    got = frame.select(H.run_status(*[F.col(c) for c in "psfa"])).collect()
    assert [row[0] for row in got] == [status for _, status in rows]


def test_place_names(spark):
    from shorepix.functions import extents as X

    rows = [({"country": "Spain"}, "None, Spain"), ({"suburb": "A", "city": "B", "bay": "C", "state": "D", "country": "E"}, "A, B, C, E"),
            ({"town": "X", "county": "x", "country": ""}, "None, X"), ({}, "None (1.5000, -2.2500)")]
    text = spark.createDataFrame([(i, str(record).replace("'", '"'), 1.5, -2.25) for i, (record, _) in enumerate(rows)], "i int, t string, lat double, lon double")
    got = text.orderBy("i").select(X.place_name(F.from_json("t", X.ADDRESS_SCHEMA), F.col("lat"), F.col("lon"))).collect()
    assert [row[0] for row in got] == [name for _, name in rows]


def test_registry(spark):
    from shorepix.operators import registry as Y

    raw = list(S.sequence_groups(S.SPATIAL, False)[0])
    rows = [("main", "f", None, None, list(S.MODE_FEATURES[S.SPECTRAL]), None, None, None, None, None, None, None),
            ("cnn", "f", "spectral-1d CNN", None, None, raw, None, [[0.0] * 4], [[1.0] * 4], None, None, None),
            ("odd", "g", "spectral_1d_cnn", None, None, raw, None, [[0.0] * 3], [[1.0] * 3], None, None, None),
            ("strange", "g", "forest", None, ["NDVI"], None, None, None, None, None, None, None),
            ("special", "f", "tabular_dense", S.SPATIAL, list(S.SPECIALIST_FEATURES), None, None, None, None, S.SPECIALIST_ROLE, None, None)]
    done = {row["model_name"]: row for row in Y.with_specialist(Y.complete_metadata(spark.createDataFrame(rows, S.REGISTRY_SCHEMA))).collect()}
    assert set(done) == {"main", "cnn", "odd", "strange"}
    assert (done["main"]["model_family"], done["main"]["feature_mode"], done["main"]["channel_groups"], done["main"]["specialist_name"]) == ("tabular_dense", S.SPECTRAL, [], "special")
    assert (done["cnn"]["feature_mode"], done["cnn"]["channel_groups"], done["cnn"]["uses_standardised"], done["cnn"]["problem"]) == (S.SPATIAL, [raw], False, None)
    assert done["odd"]["problem"] == "normalization does not fit" and done["strange"]["problem"] == "unknown family"
