"""Folders that driver and executors share, and small helpers of the operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``; where that is unset, under a folder of the session's warehouse, which driver and executors share too."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as a Parquet table in the shared folder and read again: lineage ends there, and lost executors cost no rerun of what came before."""
    path = work_dir(df.sparkSession, name)
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    try:
        spark.conf.set(key, "true")  # the job's shuffle files go when it has ended
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)
    return spark.read.schema(df.schema).parquet(path)


ROWS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Texts can be long: batches that go to Python hold so many rows at most, for as long as the session lives (plans are made when they run, after the operator has returned)."""
    if not 0 < int(spark.conf.get(ROWS_KEY)) <= rows:
        spark.conf.set(ROWS_KEY, str(rows))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """For what runs inside: batches of so many rows at most."""
    before = spark.conf.get(ROWS_KEY)
    spark.conf.set(ROWS_KEY, str(rows))
    try:
        yield
    finally:
        spark.conf.set(ROWS_KEY, before)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts, by one scan in the JVM."""
    return docs.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0


def need(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Just these columns; others, however they are named, take no part."""
    small_batches(df.sparkSession)
    return df.select(*[F.col(f"`{c}`") for c in columns])


def give_back() -> None:
    """Returns memory that a worker has freed to the system, so that workers that live on do not add up."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def drop(df: DataFrame) -> None:
    """Deletes the folder of a table made by ``written`` that nothing reads any more."""
    files = df.inputFiles()
    if files:
        folder = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
