"""Scene inputs by content, free destination names, counters of the pipeline, isolation of failing scenes, headers."""

import io
import math
import random
import struct
import zipfile

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from shorepix.operators import catalogue as K
from shorepix.operators import metrics as E
from shorepix.plans.catalogue import plan_batch
from shorepix.sources import files as Y
from shorepix.sources import scenes as Z
from shorepix.sources import tables as B
from shorepix.streaming import ingest as I

SCENE = "S2A_MSIL2A_20250601T110651_N0511_R137_T29SQA_20250601T163114"


def tiff(bands, big=False, order="<"):
    """A TIFF header and its directory: width, then the number of bands unless it is None."""
    tags = [(256, 4, 7)] + ([(277, 3, bands)] if bands is not None else [])
    mark = b"II" if order == "<" else b"MM"
    if big:
        raw = mark + struct.pack(order + "HHHQ", 43, 8, 0, 16) + struct.pack(order + "Q", len(tags))
        for tag, kind, value in tags:
            raw += struct.pack(order + "HHQ", tag, kind, 1) + struct.pack(order + ("I" if kind == 4 else "H"), value).ljust(8, b"\0")
        return raw + bytes(8)
    raw = mark + struct.pack(order + "HI", 42, 8) + struct.pack(order + "H", len(tags))
    for tag, kind, value in tags:
        raw += struct.pack(order + "HHI", tag, kind, 1) + struct.pack(order + ("I" if kind == 4 else "H"), value).ljust(4, b"\0")
    return raw + bytes(64)


def safe_zip(path, name):
    with zipfile.ZipFile(path, "w") as out:
        out.writestr(f"in/{name}.SAFE/manifest.safe", "x")
        out.writestr(f"in/{name}.SAFE/GRANULE/a/b.jp2", b"\0" * 100_000)


def test_tiff_headers():
    for big in (False, True):
        for order in "<>":
            assert Y.tiff_bands(io.BytesIO(tiff(12, big, order))) == 12
            assert Y.tiff_bands(io.BytesIO(tiff(None, big, order))) == 1
    for broken in (b"", b"II", b"II*\0", b"no image at all", tiff(12)[:9] + b"\xff" * 8, b"II*\0" + struct.pack("<I", 10 ** 6) + bytes(20)):
        assert Y.tiff_bands(io.BytesIO(broken)) in (None, 1)


def test_single_inputs_and_folders(spark, tmp_path):
    outputs = spark.createDataFrame([], "output_name string")

    def plan(path):
        batch = plan_batch(spark, str(path), "/models/m.bin", outputs)
        return {(r["scene_id"], r["format"], r["accepted"]) for r in batch.candidates.collect()}

    inside = tmp_path / "Done"  # below a status folder, single inputs still count
    inside.mkdir()
    safe = inside / f"{SCENE}.SAFE"
    (safe / "GRANULE" / "L2A").mkdir(parents=True)
    (safe / "manifest.safe").write_text("x")
    (safe / "GRANULE" / "L2A" / "f.tif").write_bytes(tiff(12))
    safe_zip(inside / "some name.zip", "INNER_SCENE")
    safe_zip(inside / f"{SCENE}.zip", "OTHER")
    (inside / "good.tif").write_bytes(tiff(12, big=True))
    (inside / "rgb.tiff").write_bytes(tiff(3))
    (inside / "text.tif").write_text("no image")
    (inside / "broken.zip").write_bytes(b"PK no archive")
    assert plan(safe) == {(SCENE, "SAFE", True)}
    assert plan(inside / "some name.zip") == {("INNER_SCENE", "ZIP", True)}
    assert plan(inside / "broken.zip") == {("broken", "ZIP", False)}
    assert plan(inside / "good.tif") == {("good", "TIFF", True)}
    assert plan(inside / "rgb.tiff") == {("rgb", "TIFF", False)}
    everything = {(SCENE, "SAFE", True), (SCENE, "ZIP", True), ("some name", "ZIP", False), ("broken", "ZIP", False), ("good", "TIFF", True),
                  ("rgb", "TIFF", False), ("text", "TIFF", False)}
    assert plan(inside) == everything and plan(tmp_path) == set()
    picked = plan_batch(spark, str(inside), "/models/m.bin", outputs)
    assert {(r["scene_id"], r["format"], r["copies"]) for r in picked.pending.collect()} == {(SCENE, "SAFE", 2), ("good", "TIFF", 1)}
    counts = spark.createDataFrame([(r["path"], 12) for r in Z.list_files(spark, str(inside / "rgb.tiff")).collect()], "path string, band_count int")
    given = plan_batch(spark, str(inside / "rgb.tiff"), "/models/m.bin", outputs, tiff_bands=counts)
    assert [r["accepted"] for r in given.candidates.collect()] == [True]
    assert "content" not in Z.archive_members(spark, str(inside)).columns and Z.archive_members(spark, str(inside), trust_names=False).count() == 4


def test_free_destinations(spark):
    def place(paths, there, status="done"):
        frame = spark.createDataFrame([(p, "kept") for p in paths], "path string, destination_note string")
        out = K.free_destinations(frame, status, spark.createDataFrame([(p,) for p in there], "path string")).collect()
        assert all(r["destination_note"] == "kept" for r in out)
        return sorted((r["path"], r["destination"]) for r in out)

    assert place(["/a/x.zip"], []) == [("/a/x.zip", "/a/Done/x.zip")]
    assert place(["/a/x.SAFE.zip"], ["/a/Done/x.SAFE.zip", "/a/Done/x_1.SAFE.zip", "/a/Done/x_3.SAFE.zip"]) == [("/a/x.SAFE.zip", "/a/Done/x_2.SAFE.zip")]
    # Equal names in one batch: the first by path takes the free name, the others the gaps.
    got = place(["/a/x.zip", "/a/Failed/x.zip", "/a/x_1.zip", "/b/x.zip"], ["/a/Done/x_2.zip"])
    assert got == [("/a/Failed/x.zip", "/a/Done/x.zip"), ("/a/x.zip", "/a/Done/x_3.zip"), ("/a/x_1.zip", "/a/Done/x_1.zip"), ("/b/x.zip", "/b/Done/x.zip")]
    assert place(["/a/Done/x.zip", "/a/x.zip"], ["/a/Done/x.zip"]) == [("/a/Done/x.zip", "/a/Done/x.zip"), ("/a/x.zip", "/a/Done/x_1.zip")]
    assert place(["/a/plain/", "/a/.hidden", "/a/end."], ["/a/Failed/plain", "/a/Failed/.hidden", "/a/Failed/end."], "failed") == [
        ("/a/.hidden", "/a/Failed/.hidden_1"), ("/a/end.", "/a/Failed/end._1"), ("/a/plain/", "/a/Failed/plain_1")]
    assert place([], ["/a/Done/x.zip"]) == []
    rng = random.Random(6)
    paths = [f"/{rng.choice('ab')}/{rng.choice(('', 'Failed/'))}{rng.choice('xy')}{rng.choice(('', '_1', '_2'))}.t.zip" for _ in range(60)]
    there = [f"/{rng.choice('ab')}/Done/{rng.choice('xy')}{rng.choice(('', '_1', '_4', '_9'))}.t.zip" for _ in range(12)]
    got = place(paths, there)
    names = [d for _, d in got]
    assert sorted(p for p, _ in got) == sorted(paths) and len(set(names)) == len(names) and not set(names) & set(there)
    wanted = {p: p.replace("/Failed", "").replace("/", "/", 1) for p in paths}
    for path, name in got:  # each number is the smallest that was free: all below are taken
        folder, base = name.rsplit("/", 1)
        goal = wanted[path].rsplit("/", 1)[1]
        if base != goal:
            stem, n = base[:-len(".t.zip")].rsplit("_", 1)
            assert stem == goal[:-len(".t.zip")] and all(f"{folder}/{stem}_{k}.t.zip" in {*names, *there} for k in range(1, int(n)))


def test_counters_are_observed_in_the_pass_that_writes(spark, tmp_path):
    import workload
    from shorepix.plans.classify import classify_pixels
    from workload import derive as D

    workload.load_all()
    pixels = D.scene_pixels(spark, "/root/testdata/sf0.001").drop("id")
    seen = Observation("all")
    classified = classify_pixels(pixels, D.main_model(), D.specialist_model(), counters=seen)
    assert classified.columns == classify_pixels(pixels, D.main_model(), D.specialist_model()).columns
    B.write_grid(classified, str(tmp_path / "grid"))
    debug = classify_pixels(pixels, D.main_model(), D.specialist_model(), smoothing=False, debug=True)
    assert seen.get["water"] == debug.where(F.col("out_class") > 0).where(F.col("NDWI") > 0).count() > 0
    without = Observation("plain")
    classify_pixels(pixels, D.main_model(), smoothing=False, counters=without).write.format("noop").mode("overwrite").save()
    assert (without.get["specialist_candidates"], without.get["smoothed"], without.get["water"]) == (0, 0, seen.get["water"])


def test_one_bad_scene_of_a_thousand_costs_few_jobs():
    calls = []

    def run(some, bad):
        calls.append(len(some))
        if broken := bad & set(some):
            raise ValueError(f"cannot read {sorted(broken)[0]}")

    scenes = [f"s{k:04}" for k in range(1000)]
    for bad in ({"s0000"}, {"s0999"}, {"s0511"}, {"s0003", "s0800"}):
        calls.clear()
        found = I.isolated(scenes, ValueError("all"), lambda some: run(some, bad))  # noqa: B023
        assert {s for s, _ in found} == bad and all("cannot read" in text for _, text in found)
        assert len(calls) <= 2 * math.ceil(math.log2(1000)) * len(bad)
    assert I.isolated(["a"], ValueError("why"), run) == [("a", "why")] and I.isolated([], ValueError("x"), run) == []


def test_headers_come_from_first_blocks(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿True_Class,x\r\nw,1\r\n".encode())
    (tmp_path / "b.csv").write_text("x,True_Class\n2,w\n" * 1)
    (tmp_path / "sub dir").mkdir()
    (tmp_path / "sub dir" / "c.csv").write_text("True_Class," + ",".join(f"column_{k:06}" for k in range(6000)) + "\nw" + ",1" * 6000 + "\n")
    (tmp_path / "empty.csv").write_text("")
    groups = dict(B.header_groups(spark, [str(tmp_path)]))
    assert sorted(len(h) for h in groups) == [len("True_Class,x"), len("x,True_Class"), 10 + 6000 * 14]
    merged = B.read_csv_tables(spark, str(tmp_path), ["True_Class", "x"])
    assert sorted((r["True_Class"], r["x"]) for r in merged.where("x is not null").collect()) == [("w", "1"), ("w", "2")] and merged.count() == 3


def test_vocabulary_without_one_row(spark):
    words = [f"label {k % 500:03}" for k in range(2000)] + [None, "", "  ", " label 007 "]
    out = E.vocabulary(spark.createDataFrame([(w,) for w in words], "l string").repartition(5), "l")
    assert [(r["label"], r["code"], r["class_count"]) for r in out.orderBy("code").collect()] == [(f"label {k:03}", k, 500) for k in range(500)]
    assert E.vocabulary(spark.createDataFrame([], "l string"), "l").count() == 0
    assert "collect_set" not in out._jdf.queryExecution().toString()
