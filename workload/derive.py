"""Pixel, scene and run tables derived from the given tables, in Spark and in the same SQL."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shorepix import schema as S
from shorepix.functions.staging import pinned
from shorepix.operators.scoring import DenseModel

from . import table

# -- pixels4: one row per line item, four bands -------------------------------------------

PIXELS4_SQL = """SELECT l_orderkey, l_linenumber, l_quantity AS "Reflectance_B02", l_extendedprice / 1000 AS "Reflectance_B03",
 l_discount * 100 + 0.0 AS "Reflectance_B04", l_tax * 100 + 0.0 AS "Reflectance_B08" FROM lineitem"""


def pixels4(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("Reflectance_B02"),
        (F.col("l_extendedprice") / 1000).alias("Reflectance_B03"),
        (F.col("l_discount") * 100 + 0.0).alias("Reflectance_B04"), (F.col("l_tax") * 100 + 0.0).alias("Reflectance_B08"))


# -- spectra: one row per embedding, twelve bands and a label -----------------------------

# Band i is the mean of components i, i + 12, i + 24 and so on, so that every component counts.
_PARTS = [range(i + 1, 65, len(S.STACK_BANDS)) for i in range(len(S.STACK_BANDS))]
BAND_VALUES_SQL = [f"({' + '.join(f'CAST(embedding[{k}] AS DOUBLE)' for k in part)}) / {len(part)}" for part in _PARTS]
SPECTRA_SQL = "SELECT vec_id, label, " + ", ".join(f'{value} + 1.0 AS "{S.raw_name(band)}"' for value, band in zip(BAND_VALUES_SQL, S.STACK_BANDS)) + " FROM embeddings"


def band_values() -> list:
    parts = [[F.element_at("embedding", k).cast("double") for k in part] for part in _PARTS]
    return [reduce(lambda a, b: a + b, part) / len(part) for part in parts]


def spectra(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", "label", *[
        (value + 1.0).alias(S.raw_name(band)) for value, band in zip(band_values(), S.STACK_BANDS)])


# -- grid: one row per order; scenes of 100 x 100 pixels with blocks, noise and gaps ------

GRID_SQL = """SELECT o_orderkey AS id, 'SCENE_' || CAST(o_orderkey // 10000 AS VARCHAR) AS scene_id,
 CAST((o_orderkey // 100) % 100 AS INTEGER) AS "row", CAST(o_orderkey % 100 AS INTEGER) AS col,
 CAST(CASE WHEN o_orderstatus = 'P' THEN 1 + o_custkey % 8
      ELSE 1 + ((((o_orderkey // 100) % 100) // 12) * 3 + ((o_orderkey % 100) // 9) * 5) % 8 END AS INTEGER) AS class_id,
 NOT (o_orderstatus = 'F' AND o_orderpriority = '5-LOW') AS valid, o_custkey, o_totalprice, o_orderpriority, o_orderdate FROM orders"""


def grid(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    row, col = F.floor(key / 100) % 100, key % 100
    block = 1 + (F.floor(row / 12) * 3 + F.floor(col / 9) * 5) % 8
    return table(spark, folder, "orders").select(
        key.alias("id"), F.concat(F.lit("SCENE_"), F.floor(key / 10000).cast("string")).alias("scene_id"),
        row.cast("int").alias("row"), col.cast("int").alias("col"),
        F.when(F.col("o_orderstatus") == "P", 1 + F.col("o_custkey") % 8).otherwise(block).cast("int").alias("class_id"),
        (~((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "5-LOW"))).alias("valid"),
        "o_custkey", "o_totalprice", "o_orderpriority", "o_orderdate")


# -- scene_pixels: the grid with reflectance that follows its class -----------------------

_BANDS = {  # band: (offset, step, multiplier, noise column, noise span)
    "B02": (300, 40, 1, "o_custkey", 50),
    "B03": (450, 45, 3, "o_custkey", 70),
    "B04": (400, 50, 5, "id", 30),
    "B05": (450, 35, 2, "id", 40),
    "B08": (420, 190, 7, "o_custkey", 90),
}
SCENE_PIXELS_SQL = "SELECT id, scene_id, \"row\", col, " + ", ".join(
    f"CASE WHEN {'valid' if band == 'B02' else 'true'} AND NOT ({'o_orderpriority = ' + chr(39) + '1-URGENT' + chr(39) if band == 'B05' else 'false'}) "
    f"THEN CAST({offset} + {step} * ((class_id * {factor}) % 8) + {noise} % {span} AS DOUBLE) END AS \"{S.raw_name(band)}\""
    for band, (offset, step, factor, noise, span) in _BANDS.items()) + " FROM grid"


def scene_pixels(spark: SparkSession, folder: str) -> DataFrame:
    source = grid(spark, folder)
    columns = []
    for band, (offset, step, factor, noise, span) in _BANDS.items():
        value = (offset + step * ((F.col("class_id") * factor) % 8) + F.col(noise) % span).cast("double")
        if band == "B02":
            value = F.when(F.col("valid"), value)
        if band == "B05":
            value = F.when(F.col("o_orderpriority") != "1-URGENT", value)
        columns.append(value.alias(S.raw_name(band)))
    return source.select("id", "scene_id", "row", "col", *columns)


# -- scene files: one row per event -------------------------------------------------------

_SCENE_ID = ("'S2' || chr(CAST(65 + user_id % 2 AS INTEGER)) || '_MSIL2A_' || strftime(ts, '%Y%m%d') || 'T' || lpad(CAST(user_id % 24 AS VARCHAR), 2, '0') || '0000_N0'"
             " || CAST(300 + (user_id * 7) % 250 AS VARCHAR) || '_R137_T29SQA_' || strftime(ts, '%Y%m%d') || 'T230000'")
LISTING_SQL = f"""SELECT event_id, user_id, event_type, value, scene_id,
 '/archive/' || CASE WHEN value < 2 THEN 'Done/' WHEN value < 4 THEN 'failed/' ELSE '' END || CAST(event_id AS VARCHAR) || '/' ||
 CASE WHEN event_type = 'error' THEN 'notes.txt' WHEN value > 120 THEN 'other_' || scene_id ELSE scene_id END ||
 CASE event_type WHEN 'view' THEN '.SAFE' WHEN 'click' THEN '.tif' WHEN 'purchase' THEN '.TIFF' WHEN 'signup' THEN '.zip' ELSE '' END AS path,
 CASE WHEN event_type = 'view' THEN value < 90 END AS has_manifest, CASE WHEN event_type = 'view' THEN true END AS has_granule,
 CASE WHEN event_type IN ('click', 'purchase') THEN CASE WHEN value < 80 THEN 12 ELSE 3 END END AS band_count
 FROM (SELECT *, {_SCENE_ID} AS scene_id FROM events)"""


def listing(spark: SparkSession, folder: str) -> DataFrame:
    user, value, kind = F.col("user_id"), F.col("value"), F.col("event_type")
    day = F.date_format("ts", "yyyyMMdd")
    scene = F.concat(
        F.lit("S2"), F.chr(65 + user % 2), F.lit("_MSIL2A_"), day, F.lit("T"), F.lpad((user % 24).cast("string"), 2, "0"),
        F.lit("0000_N0"), (300 + (user * 7) % 250).cast("string"), F.lit("_R137_T29SQA_"), day, F.lit("T230000"))
    status = F.when(value < 2, "Done/").when(value < 4, "failed/").otherwise("")
    name = F.when(kind == "error", "notes.txt").when(value > 120, F.concat(F.lit("other_"), F.col("scene_id"))).otherwise(F.col("scene_id"))
    suffix = (F.when(kind == "view", ".SAFE").when(kind == "click", ".tif").when(kind == "purchase", ".TIFF")
              .when(kind == "signup", ".zip").otherwise(""))
    tiff = kind.isin("click", "purchase")
    events = table(spark, folder, "events")
    scenes = pinned(events.select("event_id", "user_id", "event_type", "value", "ts"), {"scene_id": scene})
    path = F.concat(F.lit("/archive/"), status, F.col("event_id").cast("string"), F.lit("/"), name, suffix)
    return pinned(scenes, {"path": path}).select(
        "event_id", "user_id", "event_type", "value", "scene_id", "path",
        F.when(kind == "view", value < 90).alias("has_manifest"), F.when(kind == "view", F.lit(True)).alias("has_granule"),
        F.when(tiff, F.when(value < 80, 12).otherwise(3)).alias("band_count"))


# -- runs: one history row per event ------------------------------------------------------

RUNS_SQL = """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS started_at,
 CASE WHEN event_type = 'error' THEN 'train' ELSE 'apply' END AS workflow,
 round(value, 3) AS duration_seconds, '/models/m' || CAST(user_id % 5 AS VARCHAR) || '.pkl' AS model_path,
 '/out/' || CAST(user_id AS VARCHAR) AS output_path,
 CASE WHEN event_type IN ('view', 'click') THEN '/masks/' || CAST(user_id AS VARCHAR) || '.shp' ELSE '' END AS mask_path,
 CASE WHEN value < 20 THEN '' WHEN value < 40 THEN 'Cadiz' WHEN value < 60 THEN 'Cadiz, Spain' ELSE 'Spain (36.5, -6.2)' END AS location_name,
 CAST(user_id % 7 AS BIGINT) AS processed, CAST(event_id % 3 AS BIGINT) AS skipped, CAST(event_id % 2 * (user_id % 3) AS BIGINT) AS failed,
 -90.0 + value AS lat, -180.0 + value AS lon FROM events"""


def runs(spark: SparkSession, folder: str) -> DataFrame:
    user, event, value, kind = F.col("user_id"), F.col("event_id"), F.col("value"), F.col("event_type")
    return table(spark, folder, "events").select(
        "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("started_at"),
        F.when(kind == "error", "train").otherwise("apply").alias("workflow"),
        F.round(value, 3).alias("duration_seconds"),
        F.concat(F.lit("/models/m"), (user % 5).cast("string"), F.lit(".pkl")).alias("model_path"),
        F.concat(F.lit("/out/"), user.cast("string")).alias("output_path"),
        F.when(kind.isin("view", "click"), F.concat(F.lit("/masks/"), user.cast("string"), F.lit(".shp"))).otherwise("").alias("mask_path"),
        F.when(value < 20, "").when(value < 40, "Cadiz").when(value < 60, "Cadiz, Spain").otherwise("Spain (36.5, -6.2)").alias("location_name"),
        (user % 7).alias("processed"), (event % 3).alias("skipped"), (event % 2 * (user % 3)).alias("failed"),
        (value - 90.0).alias("lat"), (value - 180.0).alias("lon"))


# -- predictions: labelled rows with a second label ---------------------------------------

_WORDS = ("Bare Sediment", "Sand", "green algae", "Magnoliopsida", "diatoms", "Phaeophyceae", "Rhodophyta", "Water", "vauch", "Unknown")
PREDICTIONS_SQL = f"""SELECT event_id, user_id, value,
 CASE WHEN event_type = 'error' AND value < 10 THEN NULL ELSE list_extract({list(_WORDS)}, CAST(user_id % 9 AS INTEGER) + 1) END AS true_label,
 list_extract({list(_WORDS)}, CAST(CASE WHEN event_type IN ('view', 'click', 'signup') THEN user_id % 9 ELSE event_id % 10 END AS INTEGER) + 1) AS pred_label,
 CASE WHEN event_type <> 'signup' THEN value / 200 END AS ndvi FROM events"""


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    words = F.array(*map(F.lit, _WORDS))
    kind, value = F.col("event_type"), F.col("value")
    sure = kind.isin("view", "click", "signup")
    return table(spark, folder, "events").select(
        "event_id", "user_id", "value",
        F.when(~((kind == "error") & (value < 10)), F.element_at(words, (F.col("user_id") % 9).cast("int") + 1)).alias("true_label"),
        F.element_at(words, F.when(sure, F.col("user_id") % 9).otherwise(F.col("event_id") % 10).cast("int") + 1).alias("pred_label"),
        F.when(kind != "signup", value / 200).alias("ndvi"))


VOCABULARY = list(_WORDS)

# -- models given by a rule ---------------------------------------------------------------


def _weights(rows: int, columns: int, shift: float) -> list[list[float]]:
    return [[round(math.sin(1.7 * (i + 1) + 0.9 * (j + 1) * (i + 2) + shift), 3) for j in range(columns)] for i in range(rows)]


def _dense(features, hidden: int, class_ids, labels, shift: float, scales) -> DenseModel:
    n, k = len(features), len(class_ids)
    return DenseModel(
        list(features), [scales[0] if S.is_raw(f) else scales[2] for f in features], [scales[1] if S.is_raw(f) else 0.5 for f in features],
        [(_weights(hidden, n, shift), [round(0.1 * i, 3) for i in range(hidden)]),
         (_weights(k, hidden, shift + 1), [round(0.05 * i, 3) for i in range(k)])], list(class_ids), list(labels))


def main_model(scales=(650.0, 300.0, 0.3)) -> DenseModel:
    """Ten spatial features, eight hidden units, eight classes."""
    return _dense(S.MODE_FEATURES[S.SPATIAL], 8, range(1, 9), [row[1] for row in S.CLASS_LEGEND], 0.4, scales)


def line_model() -> DenseModel:
    """The same network scaled for the line item bands."""
    return main_model((15.0, 20.0, 0.4))


def specialist_model() -> DenseModel:
    return _dense(S.SPECIALIST_FEATURES, 6, (4, 5), [target[0] for target in S.SPECIALIST_TARGETS], 2.2, (650.0, 300.0, 0.3))


# -- SQL building blocks ------------------------------------------------------------------


def features_sql(source: str, bands, prefix: str = "") -> list[tuple[str, str]]:
    """CTEs that add standardized bands and feature indices to ``source``; the last one is ``<prefix>feat``."""
    raw = [f'"{S.raw_name(band)}"' for band in bands]
    ends = f"SELECT *, least({', '.join(raw)}) AS __mn, greatest({', '.join(raw)}) - least({', '.join(raw)}) AS __rg FROM {source}"
    stan = ", ".join(
        f'CASE WHEN __rg > 0 THEN ({name} - __mn) / __rg ELSE 0.0 END AS "{S.stan_name(band)}"' for name, band in zip(raw, bands))
    green, red, nir = (f'"{S.raw_name(band)}"' for band in ("B03", "B04", "B08"))
    index = ", ".join(
        f'CASE WHEN {a} + {b} = 0 THEN 0.0 ELSE ({a} - {b}) / ({a} + {b}) END AS "{name}"' for a, b, name in ((nir, red, "NDVI"), (green, nir, "NDWI")))
    return [(f"{prefix}ends", ends), (f"{prefix}feat", f"SELECT * EXCLUDE (__mn, __rg), {stan}, {index} FROM {prefix}ends")]


def dense_sql(model: DenseModel, source: str, prefix: str) -> list[tuple[str, str]]:
    """CTEs that score ``source``; ``<prefix>scored`` adds a list ``<prefix>probs``."""
    stage = [f'((coalesce("{f}", 0.0) - {m!r}) / {s!r})' for f, m, s in zip(model.features, model.mean, model.std)]
    names = [f"__{prefix}i{i}" for i in range(len(stage))]
    parts = [(f"{prefix}in", "SELECT *, " + ", ".join(f"{e} AS {n}" for e, n in zip(stage, names)) + f" FROM {source}")]
    last = f"{prefix}in"
    for depth, (weights, bias) in enumerate(model.layers):
        sums = [" + ".join([f"{float(b)!r}::DOUBLE"] + [f"{n} * {float(w)!r}::DOUBLE" for n, w in zip(names, row)]).replace("+ -", "+ -") for row, b in zip(weights, bias)]
        if depth < len(model.layers) - 1:
            sums = [f"greatest({text}, 0.0)" for text in sums]
        names = [f"__{prefix}{depth}_{i}" for i in range(len(bias))]
        name = f"{prefix}l{depth}"
        parts.append((name, "SELECT *, " + ", ".join(f"{t} AS {n}" for t, n in zip(sums, names)) + f" FROM {last}"))
        last = name
    top = f"greatest({', '.join(names)})"
    exps = ", ".join(f"exp({n} - {top})" for n in names)
    parts.append((f"{prefix}exp", f"SELECT *, [{exps}] AS __{prefix}e FROM {last}"))
    parts.append((f"{prefix}scored", f"SELECT *, list_transform(__{prefix}e, lambda v: v / list_sum(__{prefix}e)) AS {prefix}probs FROM {prefix}exp"))
    return parts


def patch_sql(source: str) -> list[tuple[str, str]]:
    """CTEs for small closed patches of ``source`` (id, scene_id, row, col, class_id; valid pixels only).

    ``patches`` holds (label, n, class_id) of closed patches of at most nine pixels, ``lab`` the
    label of every pixel, ``winners`` (label, replacement).
    """
    parts = [
        ("steps", "SELECT a.x AS dr, b.x AS dc FROM (VALUES (-1), (0), (1)) a(x), (VALUES (-1), (0), (1)) b(x) WHERE NOT (a.x = 0 AND b.x = 0)"),
        ("near", f"""SELECT p.id, q.id AS other FROM (SELECT p0.*, p0."row" + dr AS r2, p0.col + dc AS c2 FROM {source} p0, steps) p
           JOIN {source} q ON q.scene_id = p.scene_id AND q."row" = p.r2 AND q.col = p.c2 AND q.class_id = p.class_id"""),
        ("lab0", f"SELECT id, id AS label FROM {source}"),
    ]
    for i in range(8):
        parts.append((f"lab{i + 1}", f"SELECT id, min(label) AS label FROM (SELECT id, label FROM lab{i} UNION ALL SELECT n.id, l.label FROM near n JOIN lab{i} l ON l.id = n.other) GROUP BY id"))
    parts += [
        ("lab", "SELECT * FROM lab8"),
        ("open_labels", "SELECT DISTINCT a.label FROM near n JOIN lab a ON a.id = n.id JOIN lab b ON b.id = n.other WHERE a.label <> b.label"),
        ("patches", f"""SELECT l.label, count(*) AS n, min(p.class_id) AS class_id, min(p.scene_id) AS scene_id,
           min(p."row") - 2 AS r0, max(p."row") + 2 AS r1, min(p.col) - 2 AS c0, max(p.col) + 2 AS c1
           FROM lab l JOIN {source} p ON p.id = l.id WHERE l.label NOT IN (SELECT label FROM open_labels) GROUP BY l.label HAVING count(*) <= 9"""),
        ("cells", "SELECT label, scene_id, class_id, r, unnest(generate_series(c0, c1)) AS c FROM (SELECT *, unnest(generate_series(r0, r1)) AS r FROM patches)"),
        ("around", f"""SELECT b.label, b.class_id AS own, p.class_id, count(*) AS n FROM cells b
           JOIN {source} p ON p.scene_id = b.scene_id AND p."row" = b.r AND p.col = b.c JOIN lab l ON l.id = p.id WHERE l.label <> b.label GROUP BY ALL"""),
        ("winners", """SELECT label, class_id AS replacement FROM (SELECT *, sum(n) OVER (PARTITION BY label) AS total FROM around)
           WHERE total >= 8 AND n * 2 > total AND class_id <> own"""),
    ]
    return parts
