"""Line-oriented text sources."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str | list[str], header: bool = False) -> DataFrame:
    """Lines of text files as a `value` column, blank ones too; `header` skips the first line of each file.

    Only the part of a file that starts at its first byte holds a first line,
    and a task gets the lines of a part in their order.
    """
    if not header:
        return spark.read.text(path)
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    )

    def without_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = None
        for batch in batches:
            keep = []
            for now in zip(batch["file"].to_pylist(), batch["start"].to_pylist(), strict=True):
                keep.append(now == part or now[1] != 0)
                part = now
            yield batch.select(["value"]).filter(pa.array(keep, pa.bool_()))

    return lines.mapInArrow(without_first, "value string")


def first_line(spark: SparkSession, file: str) -> str | None:
    """The first line of one file."""
    row = spark.read.text(file).where(F.col("_metadata.file_block_start") == 0).first()
    return None if row is None else row["value"]


def drop_equal_lines(lines: DataFrame, header: str) -> DataFrame:
    """Drop a header by value: every line equal to it goes."""
    return lines.where(~F.col("value").eqNullSafe(F.lit(header)))
