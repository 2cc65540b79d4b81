"""Incremental scene work on growing folders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .. import schema as S
from ..operators import catalogue as K
from ..operators import history as H
from ..operators.lookup import small_table


def scene_stream(spark: SparkSession, folder: str, schema: T.StructType, archive: str | None = None,
                 files_per_batch: int | None = None, fmt: str = "parquet") -> DataFrame:
    """Stream of scene files; with ``archive`` finished files move there when their batch is done."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.load(folder)


def ingest_scenes(stream: DataFrame, process: Callable[[DataFrame], DataFrame], output: str, failed: str,
                  checkpoint: str, problem: F.Column | None = None) -> StreamingQuery:
    """Classify new scenes, isolate failing ones, and stop when nothing new is left.

    ``problem`` is an expression over scene rows that names a defect (or NULL); scenes with a
    defect go to the ``failed`` table. The rest is processed in one job. If a job fails, its scenes are halved and each
    half is run as a job of its own, down to the scenes that break it: one bad scene of n costs about 2 log2 n jobs more and
    the others still finish. Output folders are replaced per scene, hence a repeated batch leaves no half-written scene behind.
    """
    defect = problem if problem is not None else F.lit(None).cast("string")

    def record(errors: DataFrame, batch_id: int) -> None:
        errors.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{failed}/batch={batch_id}")

    def save(rows: DataFrame) -> None:
        (process(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("scene_id").parquet(output))

    def run(batch: DataFrame, batch_id: int) -> None:
        judged = batch.withColumn("__problem", defect)
        bad = judged.groupBy("scene_id").agg(F.min("__problem").alias("error")).where(F.col("error").isNotNull())
        good = batch.join(bad, "scene_id", "left_anti")
        try:
            save(good)
        except Exception as error:  # noqa: BLE001 - find the scenes that break the job
            # The names of a batch are bounded by its files, which the driver lists anyway.
            scenes = sorted(row["scene_id"] for row in good.select("scene_id").distinct().collect())
            errors = isolated(scenes, error, lambda some: save(batch.where(F.col("scene_id").isin(some))))
            bad = bad.unionByName(small_table(batch.sparkSession, errors, "scene_id string, error string"))
        record(bad, batch_id)

    return (stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def isolated(scenes: list[str], error: Exception, run: Callable[[list[str]], None]) -> list[tuple[str, str]]:
    """(scene, error text) of the scenes that break a job which failed on all of ``scenes``; ``run`` processes some."""
    if len(scenes) <= 1:
        return [(scene, str(error)) for scene in scenes]
    found, middle = [], len(scenes) // 2
    for half in (scenes[:middle], scenes[middle:]):
        try:
            run(half)
        except Exception as again:  # noqa: BLE001
            found += isolated(half, again, run)
    return found


def first_scenes(stream: DataFrame, accepted: str, checkpoint: str, arrival: str = "arrived_at") -> StreamingQuery:
    """Append the first record of every scene (ignoring case) to the table at ``accepted``, without any time horizon.

    Inside a batch the preferred format wins, then the earlier arrival, then the path. A scene that an earlier batch
    accepted is left out, however much later its copy comes. The part of a repeated batch is replaced.
    """
    columns = stream.columns
    keyed = stream.sparkSession.createDataFrame([], stream.schema).withColumn("scene_key", F.upper("scene_id"))
    keyed.write.mode("overwrite").parquet(f"{accepted}/batch=-1")  # an empty part, so that the table can be read
    order = F.struct(K.format_rank(K.file_format(F.col("path"))).alias("rank"), F.col(arrival), F.col("path"))

    def run(batch: DataFrame, batch_id: int) -> None:
        first = batch.groupBy(F.upper("scene_id").alias("scene_key")).agg(F.min_by(F.struct(*columns), order).alias("kept"))
        before = batch.sparkSession.read.parquet(accepted).where(F.col("batch") != batch_id).select("scene_key")
        new = first.join(before, "scene_key", "left_anti").select("kept.*", "scene_key")
        new.write.mode("overwrite").parquet(f"{accepted}/batch={batch_id}")

    return (stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def run_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Streaming counts and seconds per workflow and status of a growing history log."""
    return H.status_rollup(spark.readStream.schema(S.HISTORY_SCHEMA).option("mode", "DROPMALFORMED").json(folder))
