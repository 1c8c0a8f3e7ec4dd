"""Tables written to the cluster's shared folder to cut lineage."""

from __future__ import annotations

import functools
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


_STAGED: list[str] = []

# Removes the shuffle files of a statement when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_HOLDING = threading.Lock()
_HELD: dict[str, list] = {}


@functools.cache
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="propense-")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    Any path is taken, a `file:` one or one without a scheme too: a mounted
    folder has no scheme of its own. Without the setting, a cluster's folder is
    what its context checkpoints to, and a local session gets a temporary one.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = _local_scratch() if context.master.startswith("local") else context.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    return path


@contextmanager
def holding(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting for the statements inside. Threads may be inside side by side; the last one to leave gives the session its own back."""
    with _HOLDING:
        held = _HELD.setdefault(name, [0, None])
        if not held[0]:
            held[1] = spark._jsparkSession.conf().get(name)
            spark._jsparkSession.conf().set(name, value)
        held[0] += 1
    try:
        yield
    finally:
        with _HOLDING:
            held[0] -= 1
            if not held[0]:
                spark._jsparkSession.conf().set(name, held[1])


def without_shuffles(spark: SparkSession):
    """Shuffle files of the statements inside are deleted with the statements' end.

    Otherwise they stay until the driver happens to collect its garbage, and add
    up over a job's steps.
    """
    return holding(spark, _CLEANUP, "true")


def write_staged(df: DataFrame, name: str, partition_by: str | None = None, compression: str | None = None) -> str:
    """Write a table to a fresh path of the shared folder, and drop the shuffles that made it."""
    path = staging_path(df.sparkSession, name)
    writer = df.write
    if partition_by is not None:
        writer = writer.partitionBy(partition_by)
    if compression is not None:
        writer = writer.option("compression", compression)
    with without_shuffles(df.sparkSession):
        writer.parquet(path)
    return path


def discard_staged(spark: SparkSession) -> None:
    """Delete everything this process has staged, once no result needs it any more."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    while _STAGED:
        path = spark._jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        path.getFileSystem(hadoop).delete(path, True)


def stage(
    df: DataFrame,
    name: str,
    schema: T.StructType | None = None,
    partition_by: str | None = None,
    compression: str | None = None,
) -> DataFrame:
    """Write `df` once and read it back.

    Unlike a cache, the table outlives lost executors; unlike a checkpoint, it
    stays columnar, so readers still prune columns and push filters down.
    `schema` reads the files back under another, storage-compatible schema;
    `partition_by` gives each value of a column, such as the side of a split,
    files of its own; `compression` is another one than the session's.
    """
    path = write_staged(df, name, partition_by, compression)
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)
