import zipfile

import pytest
from pyspark.sql import functions as F

from shorepix.functions import names as N
from shorepix.operators import catalogue as K
from shorepix.plans.catalogue import plan_batch, require_inputs
from shorepix.sources import scenes as Z

SCENE = "S2A_MSIL2A_20250601T110651_N0511_R137_T29SQA_20250601T163114"
OTHER = "S2B_MSIL2A_20240501T110651_N0300_R137_T29SQA_20240501T163114"


def listing(spark, rows):
    return spark.createDataFrame(rows, "path string, has_manifest boolean, has_granule boolean, band_count int")


def test_candidates_and_duplicates(spark):
    rows = [
        (f"/in/a/{SCENE}.zip", None, None, None), (f"/in/b/{SCENE}.SAFE", True, True, None), (f"/in/c/{SCENE}.TIF", None, None, 12),
        (f"/in/d/{SCENE.lower()}.tif", None, None, 12), ("/in/e/plain.tif", None, None, 3), ("/in/f/some.zip", None, None, None),
        (f"/in/g/{OTHER}.SAFE", True, False, None), (f"/in/done/{OTHER}.zip", None, None, None),
        (f"/in/b/{SCENE}.SAFE/GRANULE/x.zip", None, None, None), ("/in/h/other_scene.tiff", None, None, 12),
    ]
    found = {row["path"]: row for row in K.scene_candidates(listing(spark, rows)).collect()}
    assert len(found) == 8 and f"/in/done/{OTHER}.zip" not in found
    assert [path for path, row in found.items() if not row["accepted"]] == ["/in/e/plain.tif", "/in/f/some.zip", f"/in/g/{OTHER}.SAFE"]
    # Below a root that itself lies in a status folder nothing is pruned for that reason.
    inside = listing(spark, [(f"/data/Done/x/{SCENE}.zip", None, None, None)])
    assert K.scene_candidates(inside).count() == 0 and K.scene_candidates(inside, root="/data/Done").count() == 1

    records = K.scene_records(listing(spark, rows))
    kept = {row["scene_key"]: row for row in K.preferred_scenes(records).collect()}
    assert kept[SCENE]["path"] == f"/in/b/{SCENE}.SAFE" and kept[SCENE]["copies"] == 4
    skipped = [row["skipped_path"] for row in K.duplicate_groups(records).orderBy(F.lower("skipped_path")).collect()]
    assert skipped == [f"/in/a/{SCENE}.zip", f"/in/c/{SCENE}.TIF", f"/in/d/{SCENE.lower()}.tif"]
    summary = K.batch_summary(K.scene_candidates(listing(spark, rows))).first()
    assert (summary["raw_count"], summary["unique_count"], summary["skipped_count"], summary["ignored_count"], summary["duplicate_count"]) == (5, 2, 3, 3, 1)
    assert (summary["safe_count"], summary["tiff_count"], summary["zip_count"]) == (1, 1, 0)
    order = [row["scene_key"] for row in K.catalogue_order(K.preferred_scenes(records)).collect()]
    assert order == [SCENE, "OTHER_SCENE"]  # unknown acquisition last
    assert [row["status"] for row in K.batch_listing(records).collect()].count("Used") == 2


def test_scene_names(spark):
    rows = spark.createDataFrame([(SCENE,), ("S2A_MSIL1C_20259901T110651_N0400_R137_T29SQA_20250601T163114",), ("plain",)], "id string")
    got = rows.select(N.is_scene_id(F.col("id")), N.acquired_at(F.col("id")).cast("string"), N.processing_baseline(F.col("id"))).collect()
    assert [tuple(row) for row in got] == [(True, "2025-06-01 11:06:51", 511), (True, None, 400), (False, None, None)]
    stems = spark.createDataFrame([("/a/x.SAFE.zip",), ("C:\\d\\y.TIFF",), ("z.safe/",), ("w.zip.tif",)], "p string").select(N.scene_stem(F.col("p"))).collect()
    assert [row[0] for row in stems] == ["x", "y", "z", "w.zip"]
    names = spark.range(1).select(
        N.output_name(F.lit(f"/in/{SCENE}.zip"), F.lit("/m/Shore_V1.3.0.pkl"), drop_prefix="shore[_-]*"),
        N.output_name(F.lit(""), F.lit("")), N.safe_stem(F.lit("a b/c."), "x"), N.safe_stem(F.lit(" ._"), "x"),
        K.status_destination(F.lit(f"/in/Failed/{SCENE}.zip"), "done"), K.status_destination(F.lit("/in/x.SAFE"), "failed")).first()
    assert list(names) == [f"{SCENE}_classified_V1.3.0.tif", "classified_output_classified_MODEL.tif", "a_b_c", "x", f"/in/Done/{SCENE}.zip", "/in/Failed/x.SAFE"]
    with pytest.raises(ValueError, match="Unsupported scene status"):
        K.status_destination(F.lit("x"), "lost")


def test_band_files(spark):
    base = "s.SAFE/GRANULE/L2A/IMG_DATA"
    files = spark.createDataFrame([("s", f"{base}/R10m/T_B02_10m.jp2"), ("s", f"{base}/R20m/T_B02_20m.jp2"), ("s", f"{base}/R20m/T_SCL_20m.jp2"),
                                   ("s", f"{base}/R20m/T_B03_20m.jp2")], "scene_id string, path string")
    assert {row["band"] for row in K.missing_bands(files, ("B02", "B03")).collect()} == {"B03"}
    assert K.band_files(files, ("B02",)).count() == 2
    with pytest.raises(FileNotFoundError, match="B03"):
        K.band_files(files, ("B02", "B03"))
    with pytest.raises(ValueError, match="reference grid"):
        K.missing_bands(files, ("B03",))


def test_folder_with_archives(spark, tmp_path):
    def archive(name, members):
        with zipfile.ZipFile(tmp_path / name, "w") as out:
            for member in members:
                out.writestr(member, "x")

    archive("one.zip", [f"in/{SCENE}.SAFE/manifest.safe", f"in/{SCENE}.SAFE/GRANULE/a/b.jp2", "in/zz.SAFE/manifest.safe", "in/zz.SAFE/GRANULE/q"])
    archive("two.zip", ["in/odd.SAFE/manifest.safe"])
    archive(f"{OTHER}.zip", ["nothing"])
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    members = Z.archive_members(spark, str(tmp_path))
    assert [(row["path"].split("/")[-1], row["scene_id"]) for row in K.valid_archives(members).collect()] == [("one.zip", SCENE)]
    assert Z.archive_members(spark, str(tmp_path), trust_names=False).where(F.col("path").endswith(f"{OTHER}.zip")).count() == 1

    safe = tmp_path / f"{SCENE}.SAFE"
    (safe / "GRANULE" / "L2A").mkdir(parents=True)
    (safe / "manifest.safe").write_text("x")
    (safe / "GRANULE" / "L2A" / "f.jp2").write_text("x")
    outputs = spark.createDataFrame([(f"{OTHER}_classified_m.tif",)], "output_name string")
    batch = plan_batch(spark, str(tmp_path), "/models/m.bin", outputs)
    require_inputs(batch.candidates)
    assert [row["scene_key"] for row in batch.pending.collect()] == [SCENE]
    assert [row["scene_key"] for row in batch.skipped.collect()] == [OTHER]
    assert batch.summary.first()["ignored_count"] == 3
    with pytest.raises(FileNotFoundError, match="Ignored 3"):
        require_inputs(batch.candidates.where(~F.col("accepted")))
