"""Small-patch smoothing and component sizes on tiles with a halo.

A patch of at most nine pixels lies within eight pixels of any of its members; knowing that
it is closed needs a ninth, and its box grown by two a tenth. A tile with a halo of ten
therefore decides every pixel of its core exactly, and one shuffle of the (scene, tile)
groups is enough. A group never exceeds (tile + 20) squared pixels.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the smoothing rule.
MAX_PATCH, GROW, MIN_NEIGHBOURS = 9, 2, 8
HALO = 10
TILE = 256

_STEPS = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if (dr, dc) != (0, 0)]


def _with_halo(pixels: DataFrame, tile: int) -> DataFrame:
    """Copy valid pixels near a tile border into the neighbouring tiles (four copies at most for large tiles)."""
    def homes(name: str):
        first = F.greatest(F.floor((F.col(name) - HALO) / tile), F.lit(0))
        return F.sequence(first.cast("int"), F.floor((F.col(name) + HALO) / tile).cast("int"))

    own_row, own_col = (F.floor(F.col(name) / tile).cast("int") for name in ("row", "col"))
    return (
        pixels.withColumns({"tile_row": F.explode(F.when(F.col("valid"), homes("row")).otherwise(F.array(own_row)))})
        .withColumns({"tile_col": F.explode(F.when(F.col("valid"), homes("col")).otherwise(F.array(own_col)))})
        .withColumn("core", (F.col("tile_row") == own_row) & (F.col("tile_col") == own_col))
    )


def patch_table(cls: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label grid and patch size per label; size 0 marks labels that are open or too large."""
    height, width = cls.shape
    size = height * width
    label = np.where(valid, np.arange(size).reshape(height, width), size)
    padded_cls = np.pad(np.where(valid, cls, -1), 1, constant_values=-2)
    same = [
        valid & (padded_cls[1 + dr:height + 1 + dr, 1 + dc:width + 1 + dc] == cls) for dr, dc in _STEPS
    ]
    padded = np.pad(label, 1, constant_values=size)
    views = [padded[1 + dr:height + 1 + dr, 1 + dc:width + 1 + dc] for dr, dc in _STEPS]
    centre = padded[1:-1, 1:-1]
    for _ in range(MAX_PATCH - 1):
        before = centre.copy()
        for mask, view in zip(same, views):
            np.minimum(centre, np.where(mask, view, size), out=centre)
        if np.array_equal(before, centre):
            break
    is_open = np.zeros(size + 1, dtype=bool)
    for mask, view in zip(same, views):
        is_open[centre[mask & (view != centre)]] = True
    counts = np.bincount(centre[valid], minlength=size + 1)
    counts[is_open | (counts > MAX_PATCH)] = 0
    return centre.copy(), counts


def smoothed_classes(cls: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Class grid in which small closed patches take the strict majority around them."""
    label, counts = patch_table(cls, valid)
    member = valid & (counts[label] > 0)
    if not member.any():
        return cls
    rows, cols = np.nonzero(member)
    patches, patch = np.unique(label[rows, cols], return_inverse=True)
    top = np.full(len(patches), cls.shape[0]); bottom = np.zeros(len(patches), dtype=int)  # noqa: E702
    left = np.full(len(patches), cls.shape[1]); right = np.zeros(len(patches), dtype=int)  # noqa: E702
    np.minimum.at(top, patch, rows); np.maximum.at(bottom, patch, rows)  # noqa: E702
    np.minimum.at(left, patch, cols); np.maximum.at(right, patch, cols)  # noqa: E702
    top, left = np.maximum(top - GROW, 0), np.maximum(left - GROW, 0)
    bottom, right = np.minimum(bottom + GROW + 1, cls.shape[0]), np.minimum(right + GROW + 1, cls.shape[1])

    own_class = cls.ravel()[patches]
    classes = np.unique(cls[valid])
    around = np.empty((len(classes), len(patches)), dtype=np.int64)
    for i, value in enumerate(classes):
        total = np.zeros((cls.shape[0] + 1, cls.shape[1] + 1), dtype=np.int64)
        total[1:, 1:] = (valid & (cls == value)).cumsum(0).cumsum(1)
        around[i] = total[bottom, right] - total[top, right] - total[bottom, left] + total[top, left]
        around[i] -= np.where(own_class == value, counts[patches], 0)
    everyone, best = around.sum(0), around.argmax(0)
    wins = (everyone >= MIN_NEIGHBOURS) & (2 * around.max(0) > everyone) & (classes[best] != own_class)
    out = cls.copy()
    out[rows, cols] = np.where(wins[patch], classes[best][patch], cls[rows, cols])
    return out


def _by_tile(pixels: DataFrame, column: str, target: str, tile: int, measure) -> DataFrame:
    """Run ``measure(class grid, valid grid)`` per tile and keep the core pixels of each."""
    fields = [field for field in pixels.schema.fields if field.name != target]
    schema = T.StructType([*fields, T.StructField(target, T.IntegerType())])
    names = [field.name for field in schema.fields]

    def one_tile(pdf: pd.DataFrame) -> pd.DataFrame:
        known = pdf[pdf["valid"]]
        result = np.full(len(pdf), -1, dtype=np.int64)
        if len(known):
            row0, col0 = int(known["row"].min()), int(known["col"].min())
            shape = (int(known["row"].max()) - row0 + 1, int(known["col"].max()) - col0 + 1)
            cls, valid = np.zeros(shape, dtype=np.int64), np.zeros(shape, dtype=bool)
            at = known["row"].to_numpy() - row0, known["col"].to_numpy() - col0
            cls[at], valid[at] = known[column].to_numpy(), True
            result[pdf["valid"].to_numpy()] = measure(cls, valid)[at]
        out = pdf.assign(**{target: result.astype("int32")})
        return out.loc[pdf["core"], names]

    return (
        _with_halo(pixels, tile).groupBy("scene_id", "tile_row", "tile_col").applyInPandas(one_tile, schema)
    )


def smooth_patches(pixels: DataFrame, column: str = "class_id", target: str | None = None,
                   tile: int = TILE) -> DataFrame:
    """Replace the class of small patches; needs scene_id, row, col, valid and an integer class.

    (scene_id, row, col) is unique. Invalid pixels pass through with class -1.
    """
    target = target or column
    source = pixels.withColumn("__class", F.col(column).cast("int")) if target == column else pixels
    kept = source.drop(column) if target == column else source
    return _by_tile(kept, "__class" if target == column else column, target, tile, smoothed_classes).drop("__class")


def _sizes(cls: np.ndarray, valid: np.ndarray) -> np.ndarray:
    label, counts = patch_table(cls, valid)
    return counts[label]


def patch_sizes(pixels: DataFrame, column: str = "class_id", tile: int = TILE) -> DataFrame:
    """Add ``patch_size``: pixels of the 8-connected patch, or 0 for patches above nine pixels."""
    return _by_tile(pixels, column, "patch_size", tile, _sizes)
