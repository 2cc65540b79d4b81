"""Grid, mask and extent queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shorepix import schema as S
from shorepix.functions import extents as X
from shorepix.operators import mask as M
from shorepix.operators import ranking as K
from shorepix.operators import raster as G
from shorepix.operators.lookup import attach
from shorepix.plans.classify import assemble_scene
from shorepix.plans.matching import match_images

from . import derive as D
from . import query, rounded, table, with_ctes

GRID = ("grid", D.GRID_SQL)
_BAND_LIST = ", ".join(f"'{band}'" for band in S.STACK_BANDS)


@query("stack_to_bands", f"SELECT vec_id, list_extract([{_BAND_LIST}], i) AS band, round(list_extract([{', '.join(D.BAND_VALUES_SQL)}], i), 6) AS value FROM embeddings, (SELECT unnest(generate_series(1, 12)) AS i)")
def stack_to_bands(spark, folder):
    stacks = table(spark, folder, "embeddings").select("vec_id", F.array(*D.band_values()).alias("values"))
    return rounded(G.stack_to_bands(stacks, ["vec_id"]))


@query("bands_to_wide", with_ctes([GRID], """SELECT scene_id, "row", col, o_totalprice AS "Reflectance_B02", CASE WHEN valid THEN CAST(o_custkey AS DOUBLE) END AS "Reflectance_B08",
 CAST(class_id AS DOUBLE) AS scl FROM grid"""))
def bands_to_wide(spark, folder):
    value = lambda band, column: F.struct(F.lit(band).alias("band"), column.cast("double").alias("value"))
    long = D.grid(spark, folder).select("scene_id", "row", "col", "valid", F.explode(F.array(
        value("B02", F.col("o_totalprice")), value("B08", F.col("o_custkey")), value("SCL", F.col("class_id")))).alias("b"))
    present = long.where(F.col("valid") | (F.col("b.band") != "B08"))
    return G.bands_to_wide(present.select("scene_id", "row", "col", "b.band", "b.value"), ["B02", "B08", "SCL"])


@query("resample_nearest", with_ctes([GRID, ("coarse", 'SELECT scene_id, "row", col, o_totalprice AS v FROM grid WHERE "row" < 45 AND col < 45'),
                                      ("ext", 'SELECT scene_id, max("row") AS r1, max(col) AS c1 FROM coarse GROUP BY scene_id')],
                                     """SELECT g.scene_id, g."row", g.col, g.class_id, c.v AS "Reflectance_B05" FROM grid g LEFT JOIN ext e ON e.scene_id = g.scene_id
 LEFT JOIN coarse c ON c.scene_id = g.scene_id AND c."row" = least(g."row" // 2, e.r1) AND c.col = least(g.col // 2, e.c1)"""))
def resample_nearest(spark, folder):
    grid = D.grid(spark, folder)
    coarse = grid.where((F.col("row") < 45) & (F.col("col") < 45)).select(*G.PIXEL, F.col("o_totalprice").alias("Reflectance_B05"))
    return G.resample_nearest(grid.select(*G.PIXEL, "class_id"), coarse, 2)


# Scene assembly: 10 m bands everywhere, 20 m and 60 m bands on their smaller grids.
_ASM_ID = "'S2A_L2A_' || CAST(id // 10000 AS VARCHAR) || '_N0' || CAST(300 + id // 10000 * 150 % 400 AS VARCHAR)"


@query("scene_assembly", with_ctes([GRID, ("g", f"SELECT *, {_ASM_ID} AS sid, CASE WHEN 300 + id // 10000 * 150 % 400 > 399 THEN 1000 ELSE 0 END AS off FROM grid"),
                                    ("g20", 'SELECT sid, "row", col, o_totalprice AS b05, CAST(class_id + 3 AS DOUBLE) AS scl FROM g WHERE "row" < 50 AND col < 50'),
                                    ("g60", 'SELECT sid, "row", col, CAST(o_custkey AS DOUBLE) AS b01 FROM g WHERE "row" < 16 AND col < 16'),
                                    ("e", 'SELECT sid, max("row") AS r1 FROM g20 GROUP BY sid'), ("e60", 'SELECT sid, max("row") AS r1 FROM g60 GROUP BY sid'),
                                    ("j", """SELECT g.sid, g."row", g.col, g.o_totalprice - off AS b02, CASE WHEN valid THEN o_custkey - off END AS b08, b05 - off AS b05, b01 - off AS b01, scl
 FROM g LEFT JOIN e ON e.sid = g.sid LEFT JOIN e60 ON e60.sid = g.sid LEFT JOIN g20 ON g20.sid = g.sid AND g20."row" = least(g."row" // 2, e.r1) AND g20.col = g.col // 2
 LEFT JOIN g60 ON g60.sid = g.sid AND g60."row" = least(g."row" // 6, e60.r1) AND g60.col = least(g.col // 6, 15)""")],
    """SELECT sid AS scene_id, "row", col, """ + ", ".join(f'CASE WHEN scl = 11 THEN NULL ELSE CAST({b.lower()} AS DOUBLE) END AS "{S.raw_name(b)}"' for b in ("B02", "B08", "B05", "B01"))
    + ", CASE WHEN scl = 11 THEN NULL ELSE scl END AS scl FROM j"))
def scene_assembly(spark, folder):
    number = F.floor(F.col("id") / 10000)
    scene = F.concat(F.lit("S2A_L2A_"), number.cast("string"), F.lit("_N0"), (300 + number * 150 % 400).cast("string"))
    value = lambda band, column: F.struct(F.lit(band).alias("band"), column.cast("double").alias("value"))
    on_20, on_60 = (F.col("row") < 50) & (F.col("col") < 50), (F.col("row") < 16) & (F.col("col") < 16)
    native = F.array(value("B02", F.col("o_totalprice")), value("B08", F.when(F.col("valid"), F.col("o_custkey"))),
                     F.when(on_20, value("B05", F.col("o_totalprice"))), F.when(on_20, value("SCL", F.col("class_id") + 3)),
                     F.when(on_60, value("B01", F.col("o_custkey"))))
    bands = D.grid(spark, folder).select(scene.alias("scene_id"), "row", "col", F.explode(native).alias("b")).where(F.col("b").isNotNull())
    return assemble_scene(bands.select("scene_id", "row", "col", "b.*"), ("B02", "B08", "B05", "B01"))


# Masks: one diamond with a hole per supplier, placed in the scene of its key.
_RING = ((-1, 0), (0, 1), (1, 0), (0, -1))
_CENTRE = "(s_suppkey * 370) % 1000 + 5.3 AS cx, 1000.0 - (s_suppkey * 610) % 1000 - 4.1 AS cy, 25.0 + abs(s_acctbal) / 100 AS r"
_EDGES_SQL = [
    ("sup", f"SELECT s_suppkey AS geom_id, 'SCENE_' || CAST(s_suppkey // 60 AS VARCHAR) AS scene_id, {_CENTRE} FROM supplier"),
    ("edges", " UNION ALL ".join(
        f"SELECT geom_id, scene_id, cx + {a[0]} * r * {f} AS x0, cy + {a[1]} * r * {f} AS y0, cx + {b[0]} * r * {f} AS x1, cy + {b[1]} * r * {f} AS y1 FROM sup"
        for f in (1.0, 0.5) for a, b in zip(_RING, _RING[1:] + _RING[:1]))),
]


def mask_edges(spark, folder):
    key = F.col("s_suppkey")
    cx, cy, r = (key * 370) % 1000 + 5.3, 1000.0 - (key * 610) % 1000 - 4.1, 25.0 + F.abs("s_acctbal") / 100
    ring = lambda f: F.array(*[F.array(cx + dx * r * f, cy + dy * r * f) for dx, dy in _RING])
    rings = table(spark, folder, "supplier").select(
        F.concat(F.lit("SCENE_"), F.floor(key / 60).cast("string")).alias("mask_id"), key.alias("geom_id"),
        F.posexplode(F.array(ring(1.0), ring(0.5))).alias("ring_id", "points"))
    return M.edges(rings)


def mask_scenes(spark, folder):
    grid = D.grid(spark, folder)
    return grid.groupBy("scene_id").agg((F.max("row") + 1).alias("n_rows")).select(
        "scene_id", F.col("scene_id").alias("mask_id"), F.lit(0.0).alias("origin_x"), F.lit(1000.0).alias("origin_y"), F.lit(10.0).alias("size"), "n_rows")


@query("polygon_mask", with_ctes([GRID, *_EDGES_SQL, ("inside", """SELECT DISTINCT id FROM (SELECT g.id, e.geom_id FROM grid g JOIN edges e ON e.scene_id = g.scene_id
   AND least(e.y0, e.y1) <= 1000.0 - (g."row" + 0.5) * 10.0 AND 1000.0 - (g."row" + 0.5) * 10.0 < greatest(e.y0, e.y1)
   AND e.x0 + (1000.0 - (g."row" + 0.5) * 10.0 - e.y0) * (e.x1 - e.x0) / (e.y1 - e.y0) > (g.col + 0.5) * 10.0 GROUP BY g.id, e.geom_id HAVING count(*) % 2 = 1)""")],
    """SELECT g.scene_id, g."row", g.col, i.id IS NULL AS study_site, CASE WHEN i.id IS NOT NULL THEN g.o_totalprice END AS "Reflectance_B02" FROM grid g LEFT JOIN inside i ON i.id = g.id"""))
def polygon_mask(spark, folder):
    pixels = D.grid(spark, folder).select(*G.PIXEL, F.col("o_totalprice").alias("Reflectance_B02"))
    return M.apply_mask(pixels, mask_edges(spark, folder), mask_scenes(spark, folder), ["Reflectance_B02"])


@query("mask_bounds", with_ctes(_EDGES_SQL, """SELECT scene_id AS mask_id, round(min(least(x0, x1)), 6) AS xmin, round(min(least(y0, y1)), 6) AS ymin,
 round(max(greatest(x0, x1)), 6) AS xmax, round(max(greatest(y0, y1)), 6) AS ymax FROM edges GROUP BY scene_id"""))
def mask_bounds(spark, folder):
    return rounded(M.bounds(mask_edges(spark, folder)))


# Jobs: every order is a scene box, its customer a mask box.
_JOBS_SQL = ("jobs", """SELECT o_orderkey, o_orderkey % 700 * 1.0 AS s_xmin, o_orderkey % 450 * 1.0 AS s_ymin, o_orderkey % 700 + 250.0 AS s_xmax, o_orderkey % 450 + 250.0 AS s_ymax,
 c_custkey % 1000 * 1.0 AS m_xmin, c_custkey % 720 * 1.0 AS m_ymin, c_custkey % 1000 + 20.0 + c_nationkey * 4 AS m_xmax, c_custkey % 720 + 15.0 + c_nationkey * 3 AS m_ymax
 FROM orders JOIN customer ON c_custkey = o_custkey""")


def _jobs(spark, folder):
    order, customer = F.col("o_orderkey"), F.col("c_custkey")
    scenes = table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("c_custkey"), (order % 700 * 1.0).alias("s_xmin"), (order % 450 * 1.0).alias("s_ymin"),
        (order % 700 + 250.0).alias("s_xmax"), (order % 450 + 250.0).alias("s_ymax"))
    masks = table(spark, folder, "customer").select(
        "c_custkey", (customer % 1000 * 1.0).alias("m_xmin"), (customer % 720 * 1.0).alias("m_ymin"),
        (customer % 1000 + 20.0 + F.col("c_nationkey") * 4).alias("m_xmax"), (customer % 720 + 15.0 + F.col("c_nationkey") * 3).alias("m_ymax"))
    return attach(scenes, masks, ["c_custkey"], "inner")


@query("extent_overlap", with_ctes([_JOBS_SQL], """SELECT o_orderkey,
 s_xmin <= m_xmax + 10 AND s_xmax >= m_xmin - 10 AND s_ymin <= m_ymax + 10 AND s_ymax >= m_ymin - 10 AS overlaps,
 m_xmin >= s_xmin - 10 AND m_ymin >= s_ymin - 10 AND m_xmax <= s_xmax + 10 AND m_ymax <= s_ymax + 10 AS within FROM jobs"""))
def extent_overlap(spark, folder):
    scene, mask, slack = X.box("s_"), X.box("m_"), X.tolerance(F.lit(10.0), F.lit(-10.0))
    return _jobs(spark, folder).select("o_orderkey", X.overlaps(mask, scene, slack).alias("overlaps"), X.within(mask, scene, slack).alias("within"))


@query("extent_intersection", with_ctes([_JOBS_SQL, ("cut", """SELECT o_orderkey, greatest(m_xmin - 60, s_xmin) AS xmin, greatest(m_ymin - 60, s_ymin) AS ymin,
 least(m_xmax + 60, s_xmax) AS xmax, least(m_ymax + 60, s_ymax) AS ymax FROM jobs""")],
    "SELECT o_orderkey, " + ", ".join(f"CASE WHEN xmin < xmax AND ymin < ymax THEN CAST({c} AS DOUBLE) END AS {c}" for c in ("xmin", "ymin", "xmax", "ymax")) + " FROM cut"))
def extent_intersection(spark, folder):
    cut = X.intersection(X.grown(X.box("m_")), X.box("s_"))
    return _jobs(spark, folder).withColumn("cut", cut).select("o_orderkey", "cut.xmin", "cut.ymin", "cut.xmax", "cut.ymax")


@query("majority_to_cell", """WITH c AS (SELECT l_partkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, l_linenumber) AS rn, sum(n) OVER (PARTITION BY l_partkey) AS total FROM c)
 SELECT l_partkey, l_linenumber, n AS n_label, CAST(total AS BIGINT) AS n_pixels FROM r WHERE rn = 1""")
def majority_to_cell(spark, folder):
    return G.majority_to_cell(table(spark, folder, "lineitem"), ["l_partkey"], "l_linenumber")


_LAYERS = ("out_class", "price")
_LAYER_CTE = ("layers", "SELECT CASE WHEN valid THEN CAST(class_id AS DOUBLE) ELSE -1 END AS out_class, CASE WHEN valid THEN o_totalprice / 1000 END AS price FROM grid")


def _layers(spark, folder):
    valid = F.col("valid")
    return D.grid(spark, folder).select(F.when(valid, F.col("class_id").cast("double")).otherwise(-1.0).alias("out_class"),
                                        F.when(valid, F.col("o_totalprice") / 1000).alias("price"))


@query("layer_stats", with_ctes([GRID, _LAYER_CTE], " UNION ALL ".join(
    f"SELECT '{n}' AS layer, round(min({n}), 6) AS minimum, round(max({n}), 6) AS maximum, round(avg({n}), 6) AS mean, round(stddev_pop({n}), 6) AS stddev, round(count({n}) * 100.0 / count(*), 6) AS valid_percent FROM layers" for n in _LAYERS)))
def layer_stats(spark, folder):
    return rounded(G.layer_statistics(_layers(spark, folder), _LAYERS))


@query("layer_histogram", with_ctes([GRID, _LAYER_CTE], """SELECT CAST(CASE WHEN price < 50 THEN 0 WHEN price >= 350 THEN 31 ELSE floor((price - 50) / 10) + 1 END AS BIGINT) AS bucket, count(*) AS n
 FROM layers WHERE price IS NOT NULL GROUP BY 1"""))
def layer_histogram(spark, folder):
    return G.layer_histogram(_layers(spark, folder), "price", 50, 350, 30)


@query("temporal_match", """WITH lab AS (SELECT l_orderkey, l_linenumber, s_nationkey AS tile, CAST(l_shipdate AS DATE) AS day FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
 img AS (SELECT c_nationkey AS tile, CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
 lk AS (SELECT tile, day, count(*) AS copies FROM lab GROUP BY ALL),
 m AS (SELECT lk.tile, lk.day, CAST(sum(n) AS BIGINT) AS n_images, min(abs(img.day - lk.day)) AS gap,
   min_by(img.day, abs(img.day - lk.day) * 2 + CASE WHEN img.day > lk.day THEN 1 ELSE 0 END) AS nearest
   FROM lk JOIN img ON img.tile = lk.tile AND abs(img.day - lk.day) <= 15 GROUP BY ALL)
 SELECT l_orderkey, l_linenumber, lab.tile, lab.day, m.n_images, m.nearest AS nearest_day, CAST(m.gap AS INTEGER) AS gap_days FROM lab JOIN m ON m.tile = lab.tile AND m.day = lab.day""")
def temporal_match(spark, folder):
    suppliers = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("tile"))
    labels = attach(table(spark, folder, "lineitem"), suppliers, ["l_suppkey"], "inner").select(
        "l_orderkey", "l_linenumber", "tile", F.to_date("l_shipdate").alias("day"))
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("tile"))
    images = attach(table(spark, folder, "orders"), customers, ["o_custkey"], "inner").select("tile", F.to_date("o_orderdate").alias("day"))
    return match_images(labels, images)


@query("chunk_numbering", """SELECT o_orderkey, lpad(CAST(CAST(ceil(row_number() OVER (ORDER BY o_orderkey) / 1000.0) AS BIGINT) AS VARCHAR), 4, '0') AS chunk FROM orders""")
def chunk_numbering(spark, folder):
    return K.number_chunks(table(spark, folder, "orders").select("o_orderkey"), "o_orderkey", rows_per_chunk=1000, width=4096)
