"""What both vector operators share: valid vectors, and packing of matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_valid(vector: Column) -> Column:
    """Not null, not empty, without null or non-finite components, and not zero."""
    return (
        vector.isNotNull()
        & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists(vector, lambda x: x != 0)
    )


def common_length(df: DataFrame, column: str) -> int | None:
    """The commonest length of the vectors, the larger of ties; None without vectors."""
    row = df.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return row["d"] if row else None


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as float64, values unchanged."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))

