"""Folders that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_SCOPE: ContextVar[str | None] = ContextVar("lexivec_scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local session gets a new folder of its machine; on a cluster that is an
    error, as executors would not see it."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lexivec-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def new_folder(spark: SparkSession, kind: str = "table") -> str:
    """A path that nothing uses yet, in the folder of the scratch() around the call or else in the shared folder."""
    return f"{_SCOPE.get() or shared_dir(spark)}/lexivec-{kind}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, on whatever file system it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def state_of(df: DataFrame) -> tuple[tuple[str, int, int], ...]:
    """(path, bytes, time of change) of each file that df reads: what changes when the data do."""
    spark, found = df.sparkSession, []
    for f in sorted(df.inputFiles()):
        where = spark._jvm.org.apache.hadoop.fs.Path(f)
        status = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where)
        found.append((f, status.getLen(), status.getModificationTime()))
    return tuple(found)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A scope whose intermediate tables are deleted at its end; what has to outlive it must be written elsewhere by then."""
    path = new_folder(spark, "scope")
    token = _SCOPE.set(path)
    try:
        yield path
    finally:
        _SCOPE.reset(token)
        remove(spark, path)


def materialize(df: DataFrame) -> DataFrame:
    """df written as Parquet into a new folder and read again: cuts lineage and fixes the rows for all later readers."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
