"""Confusion matrices and accuracy measures. Every measure starts from one small table of
(true, predicted, n) counts, combined before its shuffle, so hot labels do not matter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..session import cut_lineage
from .lookup import small_table


def known_label(label: Column) -> Column:
    return F.coalesce(label.cast("string"), F.lit(S.MISSING_LABEL))


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def confusion(df: DataFrame, true: str = "true_label", pred: str = "pred_label") -> DataFrame:
    """(true_label, pred_label, n) with missing labels as ``<MISSING>``."""
    return df.groupBy(known_label(F.col(true)).alias("true_label"), known_label(F.col(pred)).alias("pred_label")).agg(
        F.count(F.lit(1)).alias("n"))


def confusion_matrix(counts: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Square matrix over ``classes`` in their order, zeros for empty cells and rows."""
    spark = counts.sparkSession
    rows = small_table(spark, list(enumerate(classes)), "position int, true_label string")
    cells = counts.where(F.col("true_label").isin(*classes)).groupBy("true_label").agg(*[
        F.sum(F.when(F.col("pred_label") == name, F.col("n"))).alias(name) for name in classes])
    return (
        F.broadcast(rows).join(cells, "true_label", "left").orderBy("position")
        .select("true_label", *[F.coalesce(F.col(f"`{name}`"), F.lit(0)).alias(name) for name in classes])
    )


def class_metrics(counts: DataFrame, class_order: Sequence[str] = (), classes: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and supports per class; classes of ``class_order`` come first.

    The classes are those of the list, also where no row carries them, or without a list all labels of the truth.
    """
    hit = F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(0)
    sides = counts.select(F.explode(F.array(
        F.struct(F.col("true_label").alias("label"), F.col("n").alias("t"), F.lit(0).cast("bigint").alias("p"), hit.alias("h")),
        F.struct(F.col("pred_label").alias("label"), F.lit(0).cast("bigint").alias("t"), F.col("n").alias("p"), F.lit(0).cast("bigint").alias("h")),
    )).alias("side")).select("side.*")
    if classes:
        fixed = [(name, 0, 0, 0) for name in classes]
        sides = sides.where(F.col("label").isin(*classes)).unionByName(
            small_table(counts.sparkSession, fixed, "label string, t bigint, p bigint, h bigint"))
    summed = sides.groupBy("label").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("h").alias("h"))
    known = F.lit(True) if classes else F.col("t") > 0
    labelled = summed.where(known & (F.trim("label") != "") & (F.col("label") != S.MISSING_LABEL))
    hint = F.array(*map(F.lit, class_order)) if class_order else F.array().cast("array<string>")
    place = F.array_position(hint, F.col("label"))
    return labelled.select(
        F.when(place > 0, place).otherwise(len(class_order) + 1).cast("bigint").alias("position"),
        F.col("label").alias("Class"),
        F.lit(None).cast("double").alias("Overall_Accuracy"),
        F.try_divide("h", "p").alias("User_Accuracy_Precision"),
        F.try_divide("h", "t").alias("Producer_Accuracy_Recall"),
        F.col("t").alias("Support_True"), F.col("p").alias("Support_Pred"))


def overall_accuracy(counts: DataFrame) -> DataFrame:
    """The OVERALL row: share of equal labels over all rows, missing ones included."""
    total = F.coalesce(F.sum("n"), F.lit(0))
    return counts.agg(
        F.lit(0).cast("bigint").alias("position"), F.lit("OVERALL").alias("Class"),
        F.try_divide(F.sum(F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(0)), total).alias("Overall_Accuracy"),
        F.lit(None).cast("double").alias("User_Accuracy_Precision"),
        F.lit(None).cast("double").alias("Producer_Accuracy_Recall"),
        total.alias("Support_True"), total.alias("Support_Pred"))


def metrics_table(counts: DataFrame, class_order: Sequence[str] = (), classes: Sequence[str] = ()) -> DataFrame:
    """OVERALL row followed by the class rows."""
    rows = overall_accuracy(counts).unionByName(class_metrics(counts, class_order, classes))
    return rows.orderBy("position", "Class").drop("position")


def presence_absence(label: Column, target: str) -> Column:
    """Presence for the target label, Absence for everything else, missing labels included."""
    return F.when(F.trim(known_label(label)) == target.strip(), S.PRESENCE).otherwise(S.ABSENCE)


def presence_with_ndvi(label: Column, ndvi: Column, target: str = S.DEFAULT_TARGET) -> Column:
    """Presence for the target label unless its NDVI is below 0.246 (a missing NDVI counts as high)."""
    present = F.coalesce(label == target, F.lit(False)) & ~F.coalesce(ndvi < S.PRESENCE_NDVI, F.lit(False))
    return F.when(present, S.PRESENCE).otherwise(S.ABSENCE)


def presence_scores(df: DataFrame, true: str, pred: str) -> DataFrame:
    """One row of TP, TN, FP, FN, precision, recall, F1 and accuracy in percent."""
    t, p = F.col(true) == S.PRESENCE, F.col(pred) == S.PRESENCE
    counts = df.agg(F.count_if(t & p).alias("TP"), F.count_if(~t & ~p).alias("TN"),
                    F.count_if(~t & p).alias("FP"), F.count_if(t & ~p).alias("FN"))
    scored = counts.withColumns({
        "Precision": F.try_divide(F.col("TP"), F.col("TP") + F.col("FP")),
        "Recall": F.try_divide(F.col("TP"), F.col("TP") + F.col("FN")),
    })
    return scored.withColumns({
        "F1": F.try_divide(2 * F.col("Precision") * F.col("Recall"), F.col("Precision") + F.col("Recall")),
        "Accuracy": F.try_divide((F.col("TP") + F.col("TN")) * 100.0, F.col("TP") + F.col("TN") + F.col("FP") + F.col("FN")),
    })


def outside_predictions(counts: DataFrame, classes: Sequence[str] = ()) -> DataFrame:
    """Number of predictions outside the list of classes, or without a list, outside the labels of the truth."""
    if classes:
        outside = counts.where(~F.col("pred_label").isin(*classes))
    else:
        truth = counts.select(F.col("true_label").alias("pred_label")).where(F.col("true_label") != S.MISSING_LABEL).distinct()
        outside = counts.join(truth, "pred_label", "left_anti")
    return outside.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_outside"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """total / (K * n) per class."""
    counts = class_counts(df, label)
    totals = counts.agg(F.struct(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k")).alias("s")).scalar()
    return counts.withColumn("__s", totals).select(
        label, "n", (F.col("__s.total") / (F.col("__s.k") * F.col("n"))).alias("weight"))


def vocabulary(df: DataFrame, label: str) -> DataFrame:
    """(label, code, class_count): distinct labels with their index in sorted order; NULL is not a class.

    Labels are dealt out by ranges; the numbers of labels in the ranges before give each range its first code.
    """
    labels = df.select(F.trim(F.col(label).cast("string")).alias("label")).where(F.col("label") != "").distinct()
    parts = cut_lineage(labels.repartitionByRange("label").withColumn("__part", F.spark_partition_id()))
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))  # one row per range
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = sizes.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"), F.sum("n").over(every).cast("int").alias("class_count"))
    rank = F.row_number().over(Window.partitionBy("__part").orderBy("label")) - 1
    return parts.withColumn("__rank", rank).join(F.broadcast(offsets), "__part").select(
        "label", (F.col("__base") + F.col("__rank")).cast("int").alias("code"), "class_count")
