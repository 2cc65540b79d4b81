"""Corpus preparation: from raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shorepix.llm import decontamination, jaccard, language, line_dedup, packing
from shorepix.llm.store import lowered, staged


#: What tasks read, and hand to Python workers, at once: bytes of a batch, and rows of a Parquet file. A session that asks for
#: less keeps that. Larger ones stand in the heap, in native memory and in the worker at the same time, and an executor that
#: runs five stages keeps most of what its largest batches took.
BATCH_BYTES, READ_ROWS = 2 << 20, 512
#: Bytes of the memo of each worker that encodes; less than by default and let go after each task, as executors run four other stages.
MEMO_BYTES = 32 << 20


def in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]):
    """``stage`` in a session that reads and hands over little at once. The settings stay when the stage returns, as its
    rows are computed when they are written; they change no row."""
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        lowered(spark, "spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        lowered(spark, "spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified (naive Bayes over hashed character n-grams)."""
    return language.with_language(docs)


@in_small_batches
def lines_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; one whose lines have all been removed goes."""
    return line_dedup.remaining_documents(docs).withColumn("n_chars", F.length("text").cast("long"))


@in_small_batches
def near_duplicates_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar documents."""
    return jaccard.one_of_each_group(docs)


@in_small_batches
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@in_small_batches
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of 4096 tokens."""
    return packing.pack_documents(docs, 4096, memo_bytes=MEMO_BYTES, keep_memo=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identified),
    ("line dedup", lines_deduplicated),
    ("n-gram Jaccard join", near_duplicates_removed),
    ("benchmark decontamination", decontaminated),
    ("best-fit packing", packed),
]

#: Trained language models and a tokenizer are beyond SQL; tests/llm has brute-force versions of line dedup and of the Jaccard join.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written before the next one reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
