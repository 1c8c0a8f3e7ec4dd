"""What the operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(column: str = "embedding") -> Column:
    """Whether a vector is there, is not zero and holds only finite numbers."""
    vector = F.col(column)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def common_length(vectors: DataFrame, column: str = "embedding") -> int | None:
    """The length that most usable vectors have, the larger of equally frequent ones."""
    row = (
        vectors.where(usable(column))
        .groupBy(F.size(column).alias("length"))
        .count()
        .orderBy(F.desc("count"), F.desc("length"))
        .first()
    )
    return row["length"] if row else None


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as the rows of a matrix, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
