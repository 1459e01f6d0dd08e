"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Bytes of rows that Spark hands to a Python worker at once in a pipeline's stages: its own
#: bound of 64 MB is held several times over, by each task's Arrow buffers and its worker.
BATCH_BYTES = 4 << 20

#: The folders written by the step that runs, and those of the step before it.
_running: list[list[str]] = []
_finished: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, else below the session's warehouse.

    The warehouse is the session's own shared storage; no folder of one machine is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.sql.warehouse.dir"
    )
    path = f"{base.rstrip('/')}/scorecraft-{uuid.uuid4().hex}"
    if _running:
        _running[-1].append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Remove a written table, wherever Spark's file systems keep it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    configuration = spark.sparkContext._jsc.hadoopConfiguration()
    where.getFileSystem(configuration).delete(where, True)


@contextmanager
def step(spark: SparkSession) -> Iterator[None]:
    """A stage of a pipeline whose result is written before the next stage begins.

    What the stage before wrote for its own use is deleted now, as its result no longer
    reads it; what this one writes is deleted by the next.  So a pipeline holds the tables
    of one stage at a time.  The session's batches for Python workers are bounded by
    ``BATCH_BYTES`` from here on, as a stage's result runs after its step; rows are the same.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    while _finished:
        delete(spark, _finished.pop())
    _running.append([])
    try:
        yield
    finally:
        _finished.extend(_running.pop())


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """``df`` written as a table in the shared folder and read back.

    Cuts the lineage: a lost executor costs the stage that runs, never what is written.
    """
    path = shared_folder(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
