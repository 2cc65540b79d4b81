"""Scene catalogue: candidates, archive contents, duplicate resolution, summaries, pending work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import names as N
from ..functions.staging import pinned
from ..session import cut_lineage
from .lookup import salted_lookup

# Preference among copies of one scene.
FORMAT_ORDER = {"SAFE": 0, "TIFF": 1, "ZIP": 2}


def format_rank(fmt: Column) -> Column:
    rank = F.lit(99)
    for name, value in FORMAT_ORDER.items():
        rank = F.when(fmt == name, value).otherwise(rank)
    return rank


def file_format(path: Column) -> Column:
    """SAFE, TIFF or ZIP from the end of a path; NULL for other files."""
    end = F.lower(F.right(F.rtrim(path, F.lit("/")), F.lit(5)))
    return (F.when(end == ".safe", "SAFE").when(end.endswith(".tif") | (end == ".tiff"), "TIFF")
            .when(end.endswith(".zip"), "ZIP"))


def in_status_folder(path: Column) -> Column:
    return path.rlike(N.STATUS_FOLDER)


def inside_safe(path: Column) -> Column:
    """TRUE for anything below a .SAFE folder (the walk does not descend into one)."""
    return path.rlike(r"(?i)\.safe/+[^/]")


def scene_candidates(listing: DataFrame, root: str = "", carry: Sequence[str] = ()) -> DataFrame:
    """Classify listed paths as accepted or ignored scene inputs below ``root``.

    ``listing`` holds path and, where known, has_manifest and has_granule (for SAFE folders)
    and band_count (for TIFF files). A zip is accepted by its file name; its content is
    looked at only when a scene is opened.
    """
    path = F.substr(F.col("path"), F.lit(len(root) + 1)) if root else F.col("path")
    named = pinned(listing, {"__path": F.concat(F.lit("/"), path), "format": file_format(F.col("path"))})
    found = named.where(F.col("format").isNotNull() & ~in_status_folder(F.col("__path")) & ~inside_safe(F.col("__path")))
    found = pinned(found, {"scene_id": N.scene_stem(F.col("path"))})
    accepted = (
        F.when(F.col("format") == "SAFE", F.coalesce(F.col("has_manifest") & F.col("has_granule"), F.lit(False)))
        .when(F.col("format") == "TIFF", F.coalesce(F.col("band_count") == len(S.STACK_BANDS), F.lit(False)))
        .otherwise(N.is_scene_id(F.col("scene_id")))
    )
    return found.select("path", "scene_id", "format", accepted.alias("accepted"), *carry)


def scene_records(listing: DataFrame, root: str = "") -> DataFrame:
    """Accepted candidates with their acquisition time."""
    return with_acquisition(scene_candidates(listing, root).where("accepted").drop("accepted"))


def with_acquisition(scenes: DataFrame) -> DataFrame:
    return pinned(scenes, {"acquired_at": N.acquired_at(F.col("scene_id"))}).withColumn(
        "acquired_on", F.to_date("acquired_at"))


def _preference() -> Column:
    path = F.col("path")
    return F.struct(format_rank(F.col("format")).alias("rank"), F.lower(path).alias("lower_path"), path.alias("path"))


def preferred_scenes(records: DataFrame) -> DataFrame:
    """One record per scene (ignoring case) and its number of copies: SAFE, TIFF, ZIP, then path.

    An aggregate, not a ranking window: copies are combined before the shuffle, so a scene
    with very many copies costs one row per input partition.
    """
    kept = F.min_by(F.struct("path", "scene_id", "format", "acquired_at", "acquired_on"), _preference())
    return records.groupBy(F.upper("scene_id").alias("scene_key")).agg(
        kept.alias("kept"), F.count(F.lit(1)).alias("copies")).select("scene_key", "kept.*", "copies")


def catalogue_order(scenes: DataFrame) -> DataFrame:
    """Acquisition time with unknown last, then scene id."""
    return scenes.orderBy(F.col("acquired_at").asc_nulls_last(), F.upper("scene_id"), "path")


def _against_kept(records: DataFrame) -> DataFrame:
    # Parsed once: counting, choosing and joining read the written records.
    records = cut_lineage(records)
    best = preferred_scenes(records)
    kept = best.select(
        "scene_key", F.col("scene_id").alias("kept_id"), F.col("path").alias("kept_path"), F.col("format").alias("kept_format"))
    counts = best.select("scene_key", F.col("copies").alias("__n"))
    return salted_lookup(records.withColumn("scene_key", F.upper("scene_id")), kept, ["scene_key"], counts=counts)


def duplicate_groups(records: DataFrame) -> DataFrame:
    """One row per skipped copy, with the record that was kept instead."""
    joined = _against_kept(records).where(F.col("path") != F.col("kept_path"))
    return joined.select(F.col("kept_id").alias("scene_id"), "kept_path", "kept_format",
                         F.col("path").alias("skipped_path"), F.col("format").alias("skipped_format"))


def batch_listing(records: DataFrame) -> DataFrame:
    """Used and skipped records in listing order."""
    used = F.col("path") == F.col("kept_path")
    day = F.coalesce(F.date_format("acquired_on", "yyyy-MM-dd"), F.lit("Unknown"))
    rows = _against_kept(records).select(
        "scene_id", "format", day.alias("acquired"),
        F.when(used, "Used").otherwise("Skipped duplicate").alias("status"), "path")
    return rows.orderBy(
        F.when(F.col("acquired") == "Unknown", "9999-99-99").otherwise(F.col("acquired")), "scene_id",
        F.when(F.col("status") == "Used", 0).otherwise(1), "format", "path")


def batch_summary(candidates: DataFrame) -> DataFrame:
    """Counts of a batch in one row: raw, unique, skipped, ignored, duplicate groups, formats, dates.

    The list of dates is bounded by the calendar, every other value is a number.
    """
    records = with_acquisition(candidates.where("accepted").drop("accepted"))
    ignored = candidates.where(~F.col("accepted")).agg(F.count(F.lit(1)).alias("n")).scalar()
    kept = preferred_scenes(records)
    raw = F.coalesce(F.sum("copies"), F.lit(0))
    return kept.agg(
        raw.alias("raw_count"), F.count(F.lit(1)).alias("unique_count"),
        (raw - F.count(F.lit(1))).alias("skipped_count"),
        F.count_if(F.col("copies") > 1).alias("duplicate_count"),
        *[F.count_if(F.col("format") == name).alias(f"{name.lower()}_count") for name in FORMAT_ORDER],
        F.array_sort(F.collect_set("acquired_on")).alias("acquisition_dates"),
    ).withColumn("ignored_count", ignored)


def valid_archives(members: DataFrame) -> DataFrame:
    """(path, scene_id) of archives in which a SAFE folder holds a manifest and a granule folder.

    ``members`` holds path and member (names inside the archive). Ids that look like scenes
    win over other folder names of the same archive.
    """
    parts = F.split(F.btrim(F.regexp_replace("member", r"\\", "/"), F.lit("/")), "/")
    depth = F.aggregate(
        F.sequence(F.lit(1), F.size("parts")), F.lit(0),
        lambda found, i: F.when((found == 0) & F.upper(F.element_at("parts", i)).endswith(".SAFE"), i).otherwise(found))
    placed = members.withColumn("parts", parts).withColumn("depth", depth).where(F.col("depth") > 0)
    rest = F.upper(F.array_join(F.slice("parts", F.col("depth") + 1, F.size("parts")), "/"))
    folders = placed.select(
        "path", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("safe_dir"),
        F.element_at("parts", F.col("depth")).alias("safe_name"), rest.alias("rest")
    ).groupBy("path", "safe_dir", "safe_name").agg(
        F.bool_or(F.col("rest") == "MANIFEST.SAFE").alias("manifest"),
        F.bool_or(F.col("rest").startswith("GRANULE/")).alias("granule"))
    ids = folders.where("manifest AND granule").select(
        "path", F.regexp_replace("safe_name", r"(?i)\.safe$", "").alias("scene_id")).where("scene_id <> ''")
    # The smallest (looks like a scene first) id stands for the archive.
    return ids.groupBy("path").agg(F.min_by("scene_id", F.struct((~N.is_scene_id(F.col("scene_id"))).alias("odd"), "scene_id")).alias("scene_id"))


def _wanted_bands(required: tuple[str, ...]) -> list[str]:
    if S.REFERENCE_BAND not in required:
        raise ValueError("B02 is required as the 10 m reference grid.")
    unknown = [band for band in required if band not in S.BAND_RESOLUTION]
    if unknown:
        raise ValueError(f"Unsupported raw band requested: {unknown[0]}")
    return list(dict.fromkeys([*required, "SCL"]))


def _band_of(path: Column, wanted: list[str]) -> Column:
    """Band of a file in the image folder of a scene, if it has the fixed resolution of that band."""
    ends = F.regexp_extract(path, r"GRANULE/[^/]+/IMG_DATA/R..m/[^/]*?((?:B\w\w|SCL)_\d+m\.jp2)$", 1)
    names = F.create_map(*[F.lit(x) for band in wanted for x in (f"{band}_{S.BAND_RESOLUTION[band]}m.jp2", band)])
    return F.try_element_at(names, ends)


def missing_bands(files: DataFrame, required: tuple[str, ...] = S.STACK_BANDS, scene: str = "scene_id") -> DataFrame:
    """(scene_id, band) required but absent. A scene collects at most thirteen band names."""
    wanted = _wanted_bands(required)
    found = files.groupBy(scene).agg(F.collect_set(_band_of(F.col("path"), wanted)).alias("found"))
    gaps = F.array_except(F.array(*map(F.lit, wanted)), F.col("found"))
    return found.select(scene, F.explode(gaps).alias("band"))


def band_files(files: DataFrame, required: tuple[str, ...] = S.STACK_BANDS, scene: str = "scene_id") -> DataFrame:
    """(scene_id, band, path) of the required bands and the scene classification; a gap is an error."""
    gap = missing_bands(files, required, scene).first()
    if gap is not None:
        raise FileNotFoundError(f"Could not locate the {gap['band']} file of scene {gap[scene]}.")
    band = _band_of(F.col("path"), _wanted_bands(required)).alias("band")
    return files.select(scene, band, "path").where(F.col("band").isNotNull()).groupBy(scene, "band").agg(
        F.min("path").alias("path"))


def with_output_name(scenes: DataFrame, model_path: str, tag: str = "classified", drop_prefix: str | None = None) -> DataFrame:
    return scenes.withColumn("output_name", N.output_name(F.col("path"), F.lit(model_path), tag, drop_prefix=drop_prefix))


def pending_scenes(scenes: DataFrame, outputs: DataFrame) -> DataFrame:
    """Scenes whose output does not exist yet."""
    return scenes.join(outputs.select("output_name"), "output_name", "left_anti")


def skipped_scenes(scenes: DataFrame, outputs: DataFrame) -> DataFrame:
    """Scenes whose output exists already."""
    return scenes.join(outputs.select("output_name"), "output_name", "left_semi")


def status_destination(path: Column, status: str) -> Column:
    """Sibling Done/Failed path of a finished input; a path already in a status folder moves beside it."""
    folders = {"done": "Done", "failed": "Failed"}
    if status.strip().lower() not in folders:
        raise ValueError(f"Unsupported scene status '{status}'. Expected one of: {', '.join(folders)}.")
    parent = F.regexp_replace(F.regexp_replace(path, r"[/\\][^/\\]+[/\\]*$", ""), r"(?i)[/\\](Done|Failed)$", "")
    return F.concat_ws("/", parent, F.lit(folders[status.strip().lower()]), N.base_name(path))


#: Numbers a destination may get.
MOST_NUMBERED = 9_999


def free_destinations(inputs: DataFrame, status: str, existing: DataFrame) -> DataFrame:
    """``inputs`` (path, ...) with ``destination``, a path in the status folder that nothing else has.

    ``existing`` lists the paths that are there (path). An input that lies in its status folder already stays where it is.
    A name that is free goes to the first input (by path) that wants it; the others get the smallest free numbers from 1 in
    the order of their paths, before all suffixes: ``x.SAFE.zip``, ``x_1.SAFE.zip``. Beyond MOST_NUMBERED an error is raised.

    Inputs that want one name, and the numbered names beside it, form a group: all of them lie in one status folder.
    """
    columns = [F.col(f"`{name}`") for name in inputs.columns]
    wanted = inputs.select(F.struct(*columns).alias("__row"), F.regexp_replace("path", r"[/\\]+$", "").alias("__path")).withColumn("__want", status_destination(F.col("__path"), status))
    name = N.base_name(F.col("__want"))
    suffix = F.when(name.endswith("."), "").otherwise(F.regexp_extract(name, r"^\.*[^.]*(\..*)?$", 1))
    wanted = wanted.withColumns({"__end": suffix, "__stem": F.substr("__want", F.lit(1), F.length("__want") - F.length(suffix)), "__stays": F.col("__path") == F.col("__want")})
    known = existing.select(F.regexp_replace("path", r"[/\\]+$", "").alias("__want")).distinct()
    order = Window.partitionBy("__want").orderBy("__path")
    moved = wanted.where(~F.col("__stays")).join(known.withColumn("__there", F.lit(True)), "__want", "left")
    moved = moved.withColumn("__first", F.col("__there").isNull() & (F.row_number().over(order) == 1))
    # Numbers that are taken beside each name, by existing files and by names given just now.
    groups = moved.where(~F.col("__first")).select("__stem", "__end").distinct()
    names = known.union(moved.where("__first").select("__want")).distinct()
    piece = lambda k: F.regexp_extract("__want", r"^(.*)_([1-9][0-9]{0,3})((?:\.[^/\\]*)?)$", k)
    parts = names.select(piece(1).alias("__stem"), piece(2).try_cast("int").alias("number"), piece(3).alias("__end")).where(F.col("number").isNotNull())
    place = Window.partitionBy("__stem", "__end")
    taken = parts.join(groups, ["__stem", "__end"], "left_semi")
    # So many free numbers lie below each taken one; an input that is the k-th to be numbered passes those with fewer than k.
    taken = taken.select("__stem", "__end", (F.col("number") - F.row_number().over(place.orderBy("number"))).alias("at"), F.lit(1).alias("is_taken"))
    late = moved.where(~F.col("__first")).withColumn("at", F.row_number().over(place.orderBy("__path")))
    both = late.withColumn("is_taken", F.lit(0)).unionByName(taken, allowMissingColumns=True)
    passed = F.sum("is_taken").over(place.orderBy("at", "is_taken").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = both.withColumn("number", F.col("at") + passed).where("is_taken = 0")
    number = F.when(F.col("number") <= MOST_NUMBERED, F.col("number").cast("string")).otherwise(
        F.raise_error(F.concat(F.lit("no free destination is left for "), F.col("__want"))))
    return (wanted.where("__stays").select("__row.*", F.col("__row.path").alias("destination"))
            .unionByName(moved.where("__first").select("__row.*", F.col("__want").alias("destination")))
            .unionByName(numbered.select("__row.*", F.concat("__stem", F.lit("_"), number, "__end").alias("destination"))))
