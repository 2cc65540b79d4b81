"""Run history queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shorepix.functions import extents as X
from shorepix.operators import history as H

from . import derive as D
from . import query, rounded, table, with_ctes

RUNS = ("runs", D.RUNS_SQL)
_DETAILS = "'Scenes=' || CAST(processed + skipped + failed AS VARCHAR) || '; processed=' || CAST(processed AS VARCHAR) || '; note=a=b; failed=' || CASE WHEN failed = 1 THEN 'one' ELSE CAST(failed AS VARCHAR) END"


def _lines(spark, folder):
    number = lambda name: F.col(name).cast("string")
    details = F.concat(F.lit("Scenes="), (F.col("processed") + F.col("skipped") + F.col("failed")).cast("string"), F.lit("; processed="), number("processed"),
                       F.lit("; note=a=b; failed="), F.when(F.col("failed") == 1, "one").otherwise(number("failed")))
    text = F.to_json(F.struct("started_at", "workflow", "duration_seconds", "model_path", details.alias("details")))
    # Some lines are cut off, some hold a list, some are blank.
    damaged = (F.when(F.col("lat") < -80, F.substring(text, 1, 40)).when(F.col("lat") < -75, F.concat(F.lit("["), text, F.lit("]")))
               .when(F.col("lat") < -70, "  ").otherwise(text))
    return D.runs(spark, folder).select("event_id", damaged.alias("value"))


@query("history_parse", with_ctes([RUNS], f"""SELECT event_id, started_at, workflow, duration_seconds, model_path, processed + skipped + failed AS scenes, processed, CASE WHEN failed = 1 THEN NULL ELSE failed END AS failed, 'a=b' AS note
 FROM runs WHERE lat >= -70"""))
def history_parse(spark, folder):
    rows = H.parse_lines(_lines(spark, folder))
    details = F.col("details")
    return rows.select("event_id", "started_at", "workflow", "duration_seconds", "model_path", H.detail_number(details, "Scenes").alias("scenes"),
                       H.detail_number(details, "processed").alias("processed"), H.detail_number(details, "failed").alias("failed"),
                       H.detail_value(details, "note").alias("note"))


@query("history_key", with_ctes([RUNS], "SELECT event_id, started_at || '|' || workflow || '|' || model_path || '|' || CASE WHEN processed = 0 THEN '' ELSE output_path END AS run_key FROM runs"))
def history_key(spark, folder):
    rows = D.runs(spark, folder).withColumn("output_path", F.when(F.col("processed") != 0, F.concat(F.lit(" "), "output_path")))
    return rows.select("event_id", H.run_key().alias("run_key"))


_CORNERS = "[[lat, lon], [lat + 0.5, lon], [lat + 0.5, lon + 0.5], [lat, lon + 0.5]]"


def _with_corners(spark, folder):
    lat, lon = F.col("lat"), F.col("lon")
    return D.runs(spark, folder).withColumn("mask_extent_coords", X.extent_corners(lon, lat, lon + 0.5, lat + 0.5))


@query("history_needs_enrichment", with_ctes([RUNS], """SELECT event_id, workflow = 'apply' AND mask_path <> '' AND (location_name IN ('', '-') OR NOT (contains(location_name, ',') OR contains(location_name, '('))) AS needs_location,
 workflow = 'apply' AND mask_path <> '' AND NOT (lat >= -90 AND lat + 0.5 <= 90 AND lon >= -180 AND lon + 0.5 <= 180) AS needs_extent FROM runs"""))
def history_needs_enrichment(spark, folder):
    return _with_corners(spark, folder).select("event_id", H.needs_location().alias("needs_location"), H.needs_extent().alias("needs_extent"))


@query("extent_coords", with_ctes([RUNS, ("ok", "SELECT *, lat >= -90 AND lat + 0.5 <= 90 AND lon >= -180 AND lon + 0.5 <= 180 AS fits FROM runs")],
                                  "SELECT event_id, CASE WHEN fits THEN 4 ELSE 0 END AS n_points, " + ", ".join(
    f"CASE WHEN fits THEN round({v}, 6) END AS {n}" for n, v in (("south", "lat"), ("west", "lon"), ("north", "lat + 0.5"), ("east", "lon + 0.5"))) + " FROM ok"))
def extent_coords(spark, folder):
    points = _with_corners(spark, folder).select("event_id", X.checked_corners(F.col("mask_extent_coords")).alias("p"))
    at = lambda i, j: F.get(F.get("p", F.lit(i)), F.lit(j))
    return points.select("event_id", F.size("p").alias("n_points"), F.round(at(0, 0), 6).alias("south"), F.round(at(0, 1), 6).alias("west"),
                         F.round(at(2, 0), 6).alias("north"), F.round(at(2, 1), 6).alias("east"))


# Addresses: suburb, city, county, state and country are present for some events only.
_HAS = {"suburb": "user_id % 2 = 0", "city": "user_id % 3 <> 0", "county": "event_id % 2 = 0", "state": "event_id % 5 < 2", "country": "event_type <> 'error'"}


def _address(spark, folder):
    user, event = F.col("user_id"), F.col("event_id")
    fields = {
        "suburb": F.when(user % 2 == 0, F.concat(F.lit("Suburb "), (user % 4).cast("string"))),
        "city": F.when(user % 3 != 0, F.concat(F.lit("CITY "), (user % 5).cast("string"))),
        "county": F.when(event % 2 == 0, F.concat(F.lit("City "), (user % 5).cast("string"))).otherwise(""),
        "state": F.when(event % 5 < 2, F.lit("State")),
        "country": F.when(F.col("event_type") == "error", F.lit(None)).when(F.col("event_type") == "view", "").otherwise("Spain"),
    }
    text = F.to_json(F.struct(*[value.alias(name) for name, value in fields.items()]))
    point = [(F.floor("value") - 60).cast("double").alias("lat"), (F.floor("value") / 2).alias("lon")]
    return table(spark, folder, "events").select("event_id", text.alias("address"), *point)


@query("place_name", """WITH a AS (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'Suburb ' || CAST(user_id % 4 AS VARCHAR) ELSE 'None' END AS micro,
 CASE WHEN user_id % 3 <> 0 THEN 'CITY ' || CAST(user_id % 5 AS VARCHAR) WHEN event_id % 2 = 0 THEN 'City ' || CAST(user_id % 5 AS VARCHAR) ELSE '' END AS loc, 'None' AS sea,
 CASE WHEN event_id % 2 = 0 THEN 'City ' || CAST(user_id % 5 AS VARCHAR) WHEN event_id % 5 < 2 THEN 'State' ELSE 'None' END AS region,
 CASE event_type WHEN 'error' THEN 'None' WHEN 'view' THEN '' ELSE 'Spain' END AS country, floor(value) - 60 AS lat, floor(value) / 2 AS lon FROM events),
 u AS (SELECT *, list_filter([micro, CASE WHEN lower(loc) <> lower(micro) THEN loc END, CASE WHEN sea NOT IN (micro, loc) THEN sea END,
   CASE WHEN lower(region) NOT IN (lower(micro), lower(loc), lower(sea)) THEN region END], lambda x: x IS NOT NULL AND x <> '') AS parts FROM a),
 w AS (SELECT *, list_slice(list_filter(parts, lambda x: lower(x) <> lower(country)), 1, 3) AS before FROM u)
 SELECT event_id, CASE WHEN country = '' THEN array_to_string(list_slice(parts, 1, 4), ', ') WHEN len(before) = 0 THEN country || ' (' || printf('%.4f, %.4f', lat, lon) || ')'
 ELSE array_to_string(before, ', ') || ', ' || country END AS place FROM w""")
def place_name(spark, folder):
    rows = _address(spark, folder).withColumn("address", F.from_json("address", X.ADDRESS_SCHEMA))
    return rows.select("event_id", X.place_name(F.col("address"), F.col("lat"), F.col("lon")).alias("place"))


@query("run_status", with_ctes([RUNS], """SELECT event_id, CASE WHEN lat > 30 THEN 'failed' WHEN failed > 0 AND (processed > 0 OR skipped > 0) THEN 'partial' WHEN failed > 0 THEN 'failed'
 WHEN processed > 0 AND skipped > 0 THEN 'partial' WHEN processed = 0 AND skipped > 0 THEN 'skipped' ELSE 'success' END AS status FROM runs"""))
def run_status(spark, folder):
    rows = D.runs(spark, folder)
    return rows.select("event_id", H.run_status(F.col("processed"), F.col("skipped"), F.col("failed"), F.col("lat") > 30).alias("status"))


@query("history_recent", with_ctes([RUNS], "SELECT event_id, started_at, workflow FROM runs ORDER BY started_at DESC, event_id LIMIT 300"))
def history_recent(spark, folder):
    return H.recent_runs(D.runs(spark, folder).select("event_id", "started_at", "workflow"), tie="event_id")


@query("history_retention", with_ctes([RUNS], "SELECT event_id, started_at, workflow FROM runs ORDER BY event_id DESC LIMIT 2000"))
def history_retention(spark, folder):
    return H.retained_runs(D.runs(spark, folder).select("event_id", "started_at", "workflow"), "event_id")


@query("status_rollup", with_ctes([RUNS], """SELECT workflow, CASE WHEN failed > 0 THEN 'failed' ELSE 'success' END AS status, count(*) AS runs, round(sum(duration_seconds), 3) AS seconds FROM runs GROUP BY ALL"""))
def status_rollup(spark, folder):
    rows = D.runs(spark, folder).withColumn("status", F.when(F.col("failed") > 0, "failed").otherwise("success"))
    return rounded(H.status_rollup(rows), 3)
