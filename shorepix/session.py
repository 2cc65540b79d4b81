"""Session defaults and the one place where lineage is cut."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators are tuned for. Adaptive execution picks broadcast joins from
# measured sizes and splits skewed join partitions, so the library itself hints only
# tables whose size is fixed or checked.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(app_name: str = "shorepix", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session with the library defaults; ``conf`` uses ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a ``local[..]`` session without one gets a temporary folder, the same
    for its lifetime; on a cluster a missing setting raises."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
    return _local_folder(context.applicationId)


@functools.cache
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="shorepix-checkpoint-")


def shared_folder(spark: SparkSession) -> str:
    """A new path that all executors see."""
    return f"{checkpoint_folder(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and read it back."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint()
