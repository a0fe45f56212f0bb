"""What the two embedding operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_finite(x: Column) -> Column:
    """Whether a vector is there, not empty, and has only finite components."""
    return F.coalesce(x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))), F.lit(False))


def finite_vectors(df: DataFrame) -> DataFrame:
    """Rows with such an embedding, as doubles."""
    return df.withColumn("embedding", F.col("embedding").cast("array<double>")).filter(is_finite(F.col("embedding")))


def matrices(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of the vectors in a list column."""
    offsets = column.offsets.to_numpy()
    sizes, flat = np.diff(offsets), column.values.to_numpy(zero_copy_only=False)
    out = []
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        out.append((at, flat[offsets[at][:, None] + np.arange(n)]))
    return out
