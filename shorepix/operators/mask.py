"""Polygon masks by scan lines.

Every polygon edge is written to the pixel rows whose centre line it crosses. The sorted
crossings of a row form runs of columns, which are united over all geometries; a pixel is
inside when its column falls into one. Pixels therefore meet their mask by an equi-join on
(scene, row, block of columns), never by comparing all pixels with all edges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import extents as X

#: Columns of a block in which pixels meet the runs of their row.
BLOCK = 256

_POLYGON = "struct<type:string,coordinates:array<array<array<double>>>>"
_MULTI = "struct<type:string,coordinates:array<array<array<array<double>>>>>"


def rings_from_geojson(df: DataFrame, geometry: str = "geometry", keys: Sequence[str] = ("mask_id", "geom_id")) -> DataFrame:
    """(keys, polygon, ring_id, points) of Polygon and MultiPolygon text; missing geometries are dropped."""
    kind = F.get_json_object(F.col(geometry), "$.type")
    polygons = F.when(kind == "Polygon", F.array(F.from_json(geometry, _POLYGON)["coordinates"])).when(
        kind == "MultiPolygon", F.from_json(geometry, _MULTI)["coordinates"])
    return (
        df.where(F.col(geometry).isNotNull())
        .select(*keys, F.posexplode(polygons).alias("polygon", "rings"))
        .select(*keys, "polygon", F.posexplode("rings").alias("ring_id", "points"))
    )


def rings_from_wkt(df: DataFrame, geometry: str = "geometry", keys: Sequence[str] = ("mask_id", "geom_id")) -> DataFrame:
    """(keys, polygon, ring_id, points) of POLYGON and MULTIPOLYGON text."""
    body = F.regexp_extract(F.upper(F.trim(F.col(geometry))), r"^(?:MULTI)?POLYGON\s*\((.*)\)$", 1)
    # Polygons end in "))", rings inside one end in ")".
    polygons = F.filter(F.split(body, r"\)\s*\)\s*,?"), lambda text: F.trim(text) != "")
    rings = F.split(F.col("text"), r"\)\s*,")
    points = F.transform(
        F.split(F.regexp_replace(F.col("ring_text"), r"[()]", ""), ","),
        lambda point: F.transform(F.split(F.trim(point), r"\s+"), lambda number: number.try_cast("double")))
    return (
        df.where(F.col(geometry).isNotNull())
        .select(*keys, F.posexplode(
            F.when(F.upper(F.trim(F.col(geometry))).startswith("MULTI"), polygons).otherwise(F.array(body))
        ).alias("polygon", "text"))
        .select(*keys, "polygon", F.posexplode(rings).alias("ring_id", "ring_text"))
        .select(*keys, "polygon", "ring_id", points.alias("points"))
    )


def edges(rings: DataFrame, keys: Sequence[str] = ("mask_id", "geom_id")) -> DataFrame:
    """Consecutive point pairs of every ring as (x0, y0, x1, y1), closed if the ring is open."""
    closed = F.when(F.col("points")[0] == F.element_at("points", -1), F.col("points")).otherwise(
        F.concat(F.col("points"), F.slice("points", 1, 1)))
    steps = F.sequence(F.lit(0), F.size("closed") - 2)
    return (
        rings.where(F.size("points") >= 3).withColumn("closed", closed)
        .withColumn("i", F.explode(steps))
        .select(*keys, "ring_id",
                *[F.col("closed")[F.col("i") + step][axis].alias(f"{name}{step}")
                  for step in (0, 1) for axis, name in ((0, "x"), (1, "y"))])
    )


def bounds(edge_table: DataFrame, keys: Sequence[str] = ("mask_id",)) -> DataFrame:
    """Total bounds per mask."""
    return edge_table.groupBy(*keys).agg(
        F.min(F.least("x0", "x1")).alias("xmin"), F.min(F.least("y0", "y1")).alias("ymin"),
        F.max(F.greatest("x0", "x1")).alias("xmax"), F.max(F.greatest("y0", "y1")).alias("ymax"))


def _meeting(edge_table: DataFrame, scenes: DataFrame) -> DataFrame:
    """Each edge with the scenes whose rows it can cross.

    Scenes and edges meet in bands of y as high as the highest scene, so one mask over many scenes does not pair every edge
    with every scene. All edges beside a scene count, since they decide what is inside.
    """
    height = F.col("n_rows") * F.col("size")
    highest = F.broadcast(scenes.agg(F.max(height).alias("__high")).where(F.col("__high") > 0))  # one row

    def bands(df: DataFrame, low: Column, high: Column) -> DataFrame:
        place = lambda y: F.floor(y / F.col("__high"))
        return df.join(highest).withColumn("__band", F.explode(F.sequence(place(low), place(high)))).drop("__high")

    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    placed = bands(scenes.select("scene_id", "mask_id", "origin_x", "origin_y", "size", "n_rows", "n_cols"), F.col("origin_y") - height, F.col("origin_y"))
    sloped = bands(edge_table.where(low < high), low, high)
    met = sloped.join(placed, ["mask_id", "__band"])
    # Of the bands that both reach, the lowest stands for the pair.
    first = F.greatest(F.floor(low / F.col("__unit")), F.floor((F.col("origin_y") - height) / F.col("__unit")))
    return met.join(highest.withColumnRenamed("__high", "__unit")).where(F.col("__band") == first).drop("__band", "__unit")


def row_spans(edge_table: DataFrame, scenes: DataFrame) -> DataFrame:
    """(scene_id, row, first, last): the runs of columns whose pixel centres lie inside the mask, apart from each other.

    ``scenes`` holds scene_id, mask_id, origin_x, origin_y (upper left corner), size (pixel side), n_rows and n_cols. A
    geometry counts by the even-odd rule; geometries of one mask add up. Crossings are paired and runs united by windows
    along a row, so no row holds a list of them.
    """
    placed = _meeting(edge_table, scenes)
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    # Row centre lines with low <= y < high.
    top = F.floor((F.col("origin_y") - high) / F.col("size") - 0.5) + 1
    bottom = F.floor((F.col("origin_y") - low) / F.col("size") - 0.5)
    crossed = placed.withColumns({"top": F.greatest(top, F.lit(0)), "bottom": F.least(bottom, F.col("n_rows") - 1)}).where("top <= bottom")
    line = F.col("origin_y") - (F.col("row") + 0.5) * F.col("size")
    at = F.col("x0") + (line - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    crossings = crossed.withColumn("row", F.explode(F.sequence(F.col("top").cast("int"), F.col("bottom").cast("int")))).select(
        "scene_id", "geom_id", "row", at.alias("at"), "origin_x", "size", "n_cols")

    def first_from(x: Column) -> Column:
        """The first column whose centre is not left of ``x``."""
        guess = F.ceil((x - F.col("origin_x")) / F.col("size") - 0.5)
        centre = lambda col: F.col("origin_x") + (col + 0.5) * F.col("size")
        return F.when(centre(guess - 1) >= x, guess - 1).when(centre(guess) >= x, guess).otherwise(guess + 1)

    along = Window.partitionBy("scene_id", "row", "geom_id").orderBy("at")
    paired = crossings.withColumns({"nth": F.row_number().over(along), "until": F.lead("at").over(along)}).where("nth % 2 = 1 AND until IS NOT NULL")
    runs = paired.select("scene_id", "row", F.greatest(first_from(F.col("at")), F.lit(0)).cast("int").alias("first"),
                         F.least(first_from(F.col("until")) - 1, F.col("n_cols") - 1).cast("int").alias("last")).where("first <= last")
    across = Window.partitionBy("scene_id", "row").orderBy("first", "last")
    reached = F.max("last").over(across.rowsBetween(Window.unboundedPreceding, -1))
    starts = runs.withColumn("begins", F.when(F.coalesce(F.col("first") <= reached + 1, F.lit(False)), 0).otherwise(1))
    return (starts.withColumn("run", F.sum("begins").over(across.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
            .groupBy("scene_id", "row", "run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("run"))


def mark_study_site(pixels: DataFrame, edge_table: DataFrame, scenes: DataFrame) -> DataFrame:
    """Add ``study_site``: TRUE where the pixel centre lies *outside* the mask (the stored flag is the mask).

    Pixels meet the runs of their row in blocks of BLOCK columns; a block holds at most BLOCK / 2 runs. Without n_cols in
    ``scenes`` the widths are those of the pixels.
    """
    if "n_cols" not in scenes.columns:
        scenes = scenes.join(pixels.groupBy("scene_id").agg((F.max("col") + 1).alias("n_cols")), "scene_id")
    spans = row_spans(edge_table, scenes).withColumn("__block", F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor(F.col("last") / BLOCK))))
    blocks = spans.groupBy("scene_id", "row", "__block").agg(F.collect_list(F.struct("first", "last")).alias("__runs"))
    hit = F.exists("__runs", lambda run: F.col("col").between(run["first"], run["last"]))
    return (
        pixels.withColumn("__block", F.floor(F.col("col") / BLOCK)).join(blocks, ["scene_id", "row", "__block"], "left")
        .withColumn("study_site", ~F.coalesce(hit, F.lit(False)))
        .drop("__runs", "__block")
    )


def apply_mask(pixels: DataFrame, edge_table: DataFrame, scenes: DataFrame, layers: Sequence[str]) -> DataFrame:
    """Null the layers outside the mask and keep the flag."""
    marked = mark_study_site(pixels, edge_table, scenes)
    return marked.withColumns({name: F.when(~F.col("study_site"), F.col(name)) for name in layers})


def crop_extents(edge_table: DataFrame, scenes: DataFrame) -> DataFrame:
    """Scene box to read: the mask grown by 60 m, cut to the scene. CRS and overlap are checked.

    ``scenes`` adds crs and mask_crs to the columns of :func:`row_spans`.
    """
    placed = scenes.join(bounds(edge_table), "mask_id")
    wrong = placed.where(~F.col("crs").eqNullSafe(F.col("mask_crs")) | F.col("crs").isNull())
    if not wrong.isEmpty():
        raise ValueError("Mask and scene must share one coordinate reference system.")
    scene_box = [F.col("origin_x"), F.col("origin_y") - F.col("n_rows") * F.col("size"),
                 F.col("origin_x") + F.col("n_cols") * F.col("size"), F.col("origin_y")]
    mask_box = X.box("")
    slack = X.tolerance(F.col("size"), F.col("size"))
    if not placed.where(~X.overlaps(mask_box, scene_box, slack)).isEmpty():
        raise ValueError("Mask extent does not overlap the scene extent.")
    cut = placed.withColumn("cut", X.intersection(X.grown(mask_box), scene_box))
    if not cut.where(F.col("cut").isNull()).isEmpty():
        raise ValueError("Buffered mask extent does not intersect the scene extent.")
    return cut.select("scene_id", "cut.*")
