"""Tables and folders that all executors see."""

from __future__ import annotations

import contextlib
import functools
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@functools.cache
def _local_folder(application: str) -> str:
    """One temporary folder per local application; spark.checkpoint.dir can't be set once a session runs."""
    return tempfile.mkdtemp(prefix="llm-")


def shared_folder(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``. Only a local session without that setting gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        base = _local_folder(spark.sparkContext.applicationId)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def lowered(spark: SparkSession, name: str, most: int) -> str:
    """Set a size to ``most`` unless the session asks for less; what it was before."""
    before = spark.conf.get(name)
    number, unit = re.fullmatch(r"(-?\d+)\s*([kmgt]?)b?", before.strip().lower()).groups()
    now = int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]
    if now > most or now <= 0:
        spark.conf.set(name, str(most))
    return before


@contextlib.contextmanager
def small_batches(spark: SparkSession, most: int = 8 << 20) -> Iterator[None]:
    """Within this block Spark hands Python batches of about ``most`` bytes (a longer row goes alone), as far as the
    session does not ask for less. Batches stand in the memory of the JVM and of the worker at once."""
    before = lowered(spark, _BATCH_BYTES, most)
    try:
        yield
    finally:
        spark.conf.set(_BATCH_BYTES, before)


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: the rows are fixed from here on, and a lost
    executor costs no more than the stages after this one."""
    folder = shared_folder(df.sparkSession)
    with small_batches(df.sparkSession):
        df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def size_checked(ids: DataFrame, most: int = 2_000_000) -> DataFrame:
    """Mark a table of one or two id columns for broadcast if it was counted to hold at most ``most`` rows (about
    100 MB as a hash table); beyond that Spark joins it by a shuffle. The rows are the same either way."""
    return F.broadcast(ids) if ids.count() <= most else ids


def fresh(df: DataFrame, *names: str) -> None:
    """Raise if ``df`` already has one of the columns an operator is about to add."""
    clash = {name.lower() for name in df.columns} & {name.lower() for name in names}
    if clash:
        raise ValueError(f"input columns {sorted(clash)} clash with the columns that are added; rename them")
