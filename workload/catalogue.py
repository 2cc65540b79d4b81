"""Scene catalogue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shorepix import schema as S
from shorepix.functions import names as N
from shorepix.operators import catalogue as K

from . import derive as D
from . import query, table, with_ctes

LISTING = ("files", D.LISTING_SQL)
_PATTERN = r"(?i)^S2[A-Z]_MSIL[12][AC]?_\d{8}T\d{6}_N\d{4}_R\d{3}_T[0-9A-Z]{5}_\d{8}T\d{6}$"
_STEM = r"regexp_replace(regexp_replace(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(?i)\.zip$', ''), '(?i)\.tiff?$', ''), '(?i)\.safe$', '')"
CANDIDATES = [LISTING, ("candidates", f"""SELECT path, {_STEM} AS scene_id, fmt AS format,
  CASE fmt WHEN 'SAFE' THEN coalesce(has_manifest AND has_granule, false) WHEN 'TIFF' THEN coalesce(band_count = 12, false)
       ELSE regexp_matches({_STEM}, '{_PATTERN}') END AS accepted
  FROM (SELECT *, CASE WHEN lower(path) LIKE '%.safe' THEN 'SAFE' WHEN lower(path) LIKE '%.tif' OR lower(path) LIKE '%.tiff' THEN 'TIFF' WHEN lower(path) LIKE '%.zip' THEN 'ZIP' END AS fmt FROM files)
  WHERE fmt IS NOT NULL AND NOT regexp_matches(path, '(?i)/(Done|Failed)/')""")]
_STAMP = r"regexp_extract(scene_id, '(\d{8}T\d{6})', 1)"
RECORDS = [*CANDIDATES, ("records", f"SELECT path, scene_id, format, try_strptime({_STAMP}, '%Y%m%dT%H%M%S') AS acquired_at, CAST(try_strptime({_STAMP}, '%Y%m%dT%H%M%S') AS DATE) AS acquired_on FROM candidates WHERE accepted"),
           ("ranked", """SELECT *, upper(scene_id) AS scene_key, count(*) OVER (PARTITION BY upper(scene_id)) AS copies,
             row_number() OVER (PARTITION BY upper(scene_id) ORDER BY CASE format WHEN 'SAFE' THEN 0 WHEN 'TIFF' THEN 1 ELSE 2 END, lower(path), path) AS rn FROM records"""),
           ("kept", "SELECT * FROM ranked WHERE rn = 1")]


def candidates(spark, folder):
    return K.scene_candidates(D.listing(spark, folder).drop("scene_id"))


def records(spark, folder):
    return K.with_acquisition(candidates(spark, folder).where("accepted").drop("accepted"))


@query("scene_candidates", with_ctes(CANDIDATES, "SELECT * FROM candidates"))
def scene_candidates(spark, folder):
    return candidates(spark, folder)


@query("scene_id_parse", with_ctes([LISTING, ("ids", f"SELECT event_id, CASE WHEN value > 100 THEN replace(scene_id, 'T29', 'X') WHEN value > 90 THEN replace(scene_id, '_2024', '_2099') ELSE scene_id END AS scene_id FROM files")],
                                   f"""SELECT event_id, regexp_matches(scene_id, '{_PATTERN}') AS is_scene, CASE WHEN regexp_matches(scene_id, '{_PATTERN}') THEN split_part(scene_id, '_', 1) END AS mission,
 CASE WHEN regexp_matches(scene_id, '{_PATTERN}') THEN split_part(scene_id, '_', 6) END AS tile, try_strptime({_STAMP}, '%Y%m%dT%H%M%S') AS acquired_at,
 CAST(try_strptime({_STAMP}, '%Y%m%dT%H%M%S') AS DATE) AS acquired_on, TRY_CAST(substr(split_part(scene_id, '_', 4), 2, 4) AS INTEGER) AS baseline FROM ids"""))
def scene_id_parse(spark, folder):
    value, scene = F.col("value"), F.col("scene_id")
    ids = D.listing(spark, folder).select("event_id", F.when(value > 100, F.replace(scene, F.lit("T29"), F.lit("X")))
                                          .when(value > 90, F.replace(scene, F.lit("_2024"), F.lit("_2099"))).otherwise(scene).alias("scene_id"))
    return K.with_acquisition(ids).select(
        "event_id", N.is_scene_id(scene).alias("is_scene"), N.scene_part(scene, "mission").alias("mission"), N.scene_part(scene, "tile").alias("tile"),
        "acquired_at", "acquired_on", N.processing_baseline(scene).alias("baseline"))


@query("preferred_scene", with_ctes(RECORDS, "SELECT scene_key, path, scene_id, format, acquired_at, acquired_on, copies FROM kept ORDER BY acquired_at NULLS LAST, scene_key"))
def preferred_scene(spark, folder):
    return K.catalogue_order(K.preferred_scenes(records(spark, folder)))


@query("duplicate_groups", with_ctes(RECORDS, """SELECT k.scene_id, k.path AS kept_path, k.format AS kept_format, r.path AS skipped_path, r.format AS skipped_format
 FROM ranked r JOIN kept k ON k.scene_key = r.scene_key WHERE r.rn > 1"""))
def duplicate_groups(spark, folder):
    return K.duplicate_groups(records(spark, folder))


@query("batch_listing", with_ctes(RECORDS, "SELECT scene_id, format, coalesce(strftime(acquired_on, '%Y-%m-%d'), 'Unknown') AS acquired, CASE WHEN rn = 1 THEN 'Used' ELSE 'Skipped duplicate' END AS status, path FROM ranked"))
def batch_listing(spark, folder):
    return K.batch_listing(records(spark, folder))


@query("batch_summary", with_ctes(RECORDS, """SELECT CAST(sum(copies) AS BIGINT) AS raw_count, count(*) AS unique_count, CAST(sum(copies) - count(*) AS BIGINT) AS skipped_count,
 count(*) FILTER (copies > 1) AS duplicate_count, count(*) FILTER (format = 'SAFE') AS safe_count, count(*) FILTER (format = 'TIFF') AS tiff_count, count(*) FILTER (format = 'ZIP') AS zip_count,
 array_to_string(list_sort(list(DISTINCT strftime(acquired_on, '%Y-%m-%d'))), ',') AS acquisition_dates, (SELECT count(*) FROM candidates WHERE NOT accepted) AS ignored_count FROM kept"""))
def batch_summary(spark, folder):
    summary = K.batch_summary(candidates(spark, folder))
    return summary.withColumn("acquisition_dates", F.array_join(F.transform("acquisition_dates", lambda day: F.date_format(day, "yyyy-MM-dd")), ","))


# Archive members: every event is a member of the archive of its user.
_MEMBER = """CASE event_type WHEN 'view' THEN folder || '/manifest.safe' WHEN 'click' THEN folder || '/GRANULE/L2A/B02.jp2' WHEN 'signup' THEN 'readme.txt'
 WHEN 'purchase' THEN folder || '/manifest.safe/extra' ELSE replace(folder, '/', chr(92)) || chr(92) || 'granule' || chr(92) || 'x.jp2' END"""


@query("archive_valid_scenes", f"""WITH m AS (SELECT '/zips/' || CAST(user_id AS VARCHAR) || '.zip' AS path, 'in/' || CASE WHEN value < 5 THEN 'x' || CAST(user_id % 3 AS VARCHAR) ELSE
   'S2A_MSIL2A_' || strftime(ts, '%Y%m%d') || 'T110651_N0511_R137_T29SQA_20240601T163114' END || '.SAFE' AS folder, event_type FROM events),
 p AS (SELECT path, {_MEMBER} AS member, folder, event_type FROM m),
 f AS (SELECT path, folder, bool_or(event_type = 'view') AS manifest, bool_or(event_type IN ('click', 'error')) AS granule FROM p WHERE event_type <> 'signup' GROUP BY ALL),
 ids AS (SELECT path, regexp_replace(folder[4:], '\\.SAFE$', '') AS scene_id FROM f WHERE manifest AND granule)
 SELECT path, min_by(scene_id, CASE WHEN scene_id LIKE 'S2A%' THEN '0' ELSE '1' END || scene_id) AS scene_id FROM ids GROUP BY path""")
def archive_valid_scenes(spark, folder):
    user, kind = F.col("user_id").cast("string"), F.col("event_type")
    name = F.when(F.col("value") < 5, F.concat(F.lit("x"), (F.col("user_id") % 3).cast("string"))).otherwise(
        F.concat(F.lit("S2A_MSIL2A_"), F.date_format("ts", "yyyyMMdd"), F.lit("T110651_N0511_R137_T29SQA_20240601T163114")))
    safe = F.concat(F.lit("in/"), name, F.lit(".SAFE"))
    member = (F.when(kind == "view", F.concat(safe, F.lit("/manifest.safe"))).when(kind == "click", F.concat(safe, F.lit("/GRANULE/L2A/B02.jp2")))
              .when(kind == "signup", "readme.txt").when(kind == "purchase", F.concat(safe, F.lit("/manifest.safe/extra")))
              .otherwise(F.concat(F.translate(safe, "/", "\\"), F.lit("\\granule\\x.jp2"))))
    members = table(spark, folder, "events").select(F.concat(F.lit("/zips/"), user, F.lit(".zip")).alias("path"), member.alias("member"))
    return K.valid_archives(members)


# Band files: every line item is a file of the scene of its order.
_BANDS = [*S.STACK_BANDS, "SCL", "TCI"]
_BAND = f"list_extract({_BANDS}, CAST(l_quantity AS INTEGER) % 14 + 1)"
_RES = "CASE WHEN l_quantity > 40 THEN 10 WHEN l_quantity > 20 THEN 20 ELSE 60 END"


@query("missing_bands", f"""WITH f AS (SELECT l_orderkey AS scene_id, {_BAND} AS band, {_RES} AS res FROM lineitem),
 dim AS (SELECT * FROM (VALUES {', '.join(f"('{b}', {r})" for b, r in S.BAND_RESOLUTION.items())}) d(band, res)),
 found AS (SELECT DISTINCT f.scene_id, f.band FROM f JOIN dim ON dim.band = f.band AND dim.res = f.res), scenes AS (SELECT DISTINCT scene_id FROM f)
 SELECT s.scene_id, d.band FROM scenes s CROSS JOIN dim d WHERE NOT EXISTS (SELECT 1 FROM found x WHERE x.scene_id = s.scene_id AND x.band = d.band)""")
def missing_bands(spark, folder):
    quantity = F.col("l_quantity")
    band = F.element_at(F.array(*map(F.lit, _BANDS)), quantity.cast("int") % 14 + 1)
    side = F.when(quantity > 40, "10").when(quantity > 20, "20").otherwise("60")
    files = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("scene_id"), F.concat(
        F.lit("/a/"), F.col("l_orderkey").cast("string"), F.lit(".SAFE/GRANULE/L2A/IMG_DATA/R"), side, F.lit("m/T29_"), band, F.lit("_"), side, F.lit("m.jp2")).alias("path"))
    return K.missing_bands(files)


_OUT = "scene_id || '_classified_main-v1.3.tif'"
_MODEL = "/models/main v1.3.bin"
_DONE = ("outputs", f"SELECT DISTINCT scene_id || '_classified_main-v1.3.tif' AS output_name FROM files WHERE value < 15")


def _outputs(spark, folder):
    return D.listing(spark, folder).where("value < 15").select(N.output_name(F.col("scene_id"), F.lit(_MODEL)).alias("output_name"))


def _named(spark, folder):
    return K.with_output_name(K.preferred_scenes(records(spark, folder)), _MODEL).select("scene_key", "path", "output_name")


@query("output_names", with_ctes(CANDIDATES, f"SELECT path, {_OUT} AS output_name FROM candidates"))
def output_names(spark, folder):
    return K.with_output_name(candidates(spark, folder), _MODEL).select("path", "output_name")


@query("pending_scenes", with_ctes([*RECORDS, _DONE], f"SELECT scene_key, path, {_OUT} AS output_name FROM kept WHERE {_OUT} NOT IN (SELECT output_name FROM outputs)"))
def pending_scenes(spark, folder):
    return K.pending_scenes(_named(spark, folder), _outputs(spark, folder)).select("scene_key", "path", "output_name")


@query("skipped_scenes", with_ctes([*RECORDS, _DONE], f"SELECT scene_key, path, {_OUT} AS output_name FROM kept WHERE {_OUT} IN (SELECT output_name FROM outputs)"))
def skipped_scenes(spark, folder):
    return K.skipped_scenes(_named(spark, folder), _outputs(spark, folder)).select("scene_key", "path", "output_name")


@query("status_destination", with_ctes([LISTING], """SELECT path, '/archive/' || split_part(path, '/', 3) || CASE WHEN value < 4 THEN '/' || split_part(path, '/', 4) ELSE '' END
 || '/Failed/' || regexp_extract(path, '([^/]*)$', 1) AS target FROM files"""))
def status_destination(spark, folder):
    return D.listing(spark, folder).select("path", K.status_destination(F.col("path"), "failed").alias("target"))


_MOVES = """src AS (SELECT '/in/d' || CAST(p_size % 5 AS VARCHAR) || CASE WHEN p_partkey % 3 = 0 THEN '/Failed' ELSE '' END || '/' || replace(p_brand, '#', '.') || '.SAFE.zip' AS path,
  '/in/d' || CAST(p_size % 5 AS VARCHAR) || '/Done/' || split_part(p_brand, '#', 1) AS stem, '.' || split_part(p_brand, '#', 2) || '.SAFE.zip' AS ending, p_partkey, p_brand FROM part),
 there AS (SELECT DISTINCT stem || CASE WHEN p_partkey % 2 = 0 THEN '_' || CAST(p_partkey % 7 AS VARCHAR) ELSE '' END || ending AS name FROM src WHERE p_partkey % 11 = 0)"""


@query("free_destinations", f"""WITH {_MOVES},
 ranked AS (SELECT *, row_number() OVER (PARTITION BY stem, ending ORDER BY path) AS nth, stem || ending IN (SELECT name FROM there) AS held FROM src),
 named AS (SELECT name FROM there UNION SELECT stem || ending FROM ranked WHERE nth = 1 AND NOT held),
 late AS (SELECT *, row_number() OVER (PARTITION BY stem, ending ORDER BY path) AS k FROM ranked WHERE held OR nth > 1),
 numbers AS (SELECT stem, ending, unnest(generate_series(1, max(k) + 20)) AS number FROM late GROUP BY stem, ending),
 free AS (SELECT stem, ending, number, row_number() OVER (PARTITION BY stem, ending ORDER BY number) AS k FROM numbers
  WHERE stem || '_' || CAST(number AS VARCHAR) || ending NOT IN (SELECT name FROM named))
 SELECT path, stem || ending AS destination FROM ranked WHERE nth = 1 AND NOT held
 UNION ALL SELECT path, stem || '_' || CAST(number AS VARCHAR) || ending FROM late JOIN free USING (stem, ending, k)""")
def free_destinations(spark, folder):
    part = table(spark, folder, "part")
    brand, key = F.split("p_brand", "#"), F.col("p_partkey")
    place, ending = F.concat(F.lit("/in/d"), (F.col("p_size") % 5).cast("string")), F.concat(F.lit("."), brand[1], F.lit(".SAFE.zip"))
    paths = part.select(F.concat(place, F.when(key % 3 == 0, "/Failed").otherwise(""), F.lit("/"), brand[0], ending).alias("path"))
    number = F.when(key % 2 == 0, F.concat(F.lit("_"), (key % 7).cast("string"))).otherwise("")
    there = part.where(key % 11 == 0).select(F.concat(place, F.lit("/Done/"), brand[0], number, ending).alias("path"))
    return K.free_destinations(paths, "done", there)
