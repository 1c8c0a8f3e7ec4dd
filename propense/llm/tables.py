"""What the operators of this subpackage share: reading tables, free column names, batches of texts."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

Item = TypeVar("Item")

# Bytes of a batch on its way to a worker, which the JVM and the worker hold at once, each in buffers of up to twice that.
SENT_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that starts with `stem` and that the table does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def by_bytes(items: Iterable[Item], size, limit: int) -> Iterator[list[Item]]:
    """Runs of consecutive items of at most `limit` bytes together; a larger item stands alone."""
    run: list[Item] = []
    held = 0
    for item in items:
        n = size(item)
        if run and held + n > limit:
            yield run
            run, held = [], 0
        run.append(item)
        held += n
    if run:
        yield run


def texts_of(column: pa.Array) -> Iterator[str]:
    """The texts of an Arrow column one by one, null as empty, without a list of them all."""
    for value in column:
        yield value.as_py() or ""


def give_back() -> None:
    """Return this process's free memory to the system: a worker outlives its tasks, and idle ones stay beside others.

    Where the C library has no such call, only Arrow's memory is returned.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs started within send batches of at most about SENT_BYTES to the workers; the session's setting comes back after."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, SENT_BYTES)
    try:
        yield
    finally:
        spark.conf.set(name, before)
