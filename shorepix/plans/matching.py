"""Match ground labels with images of the same place within fifteen days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lookup import attach

WINDOW_DAYS = 15  # fixed value


def match_images(labels: DataFrame, images: DataFrame, window: int = WINDOW_DAYS) -> DataFrame:
    """Add n_images, nearest_day and gap_days to every label that has an image within ``window`` days.

    ``labels`` and ``images`` hold tile and day (DATE). Images are first reduced to counts per
    (tile, day). Each such day offers itself to the 31 label days around it, and an aggregate
    keeps the number of images and the nearest day (the earlier one on ties) per label day. A
    label then meets exactly one row, however many images or labels its tile has.
    """
    days = images.groupBy("tile", "day").agg(F.count(F.lit(1)).alias("n"))
    shifts = F.array(*[F.lit(step) for step in range(-window, window + 1)])
    offers = days.withColumn("shift", F.explode(shifts)).select(
        "tile", F.date_add("day", F.col("shift")).alias("label_day"), F.abs("shift").alias("gap"), "day", "n")
    best = offers.groupBy("tile", F.col("label_day").alias("day")).agg(
        F.sum("n").alias("n_images"), F.min(F.struct("gap", offers["day"])).alias("near"))
    per_day = best.select("tile", "day", "n_images", F.col("near.day").alias("nearest_day"), F.col("near.gap").alias("gap_days"))
    return attach(labels, per_day, ["tile", "day"], "inner")
