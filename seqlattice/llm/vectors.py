"""Vectors that take part in searches, each distinct one once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vec: Column) -> Column:
    """Whether a vector is not null or empty, has only finite components and is not zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def vector_key(vec: Column) -> Column:
    """64-bit name of a vector's values; -0.0 counts as 0.0."""
    return F.xxhash64(F.transform(vec.cast("array<double>"), lambda x: x + F.lit(0.0)))


def keyed(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id, vec, key`` per row; the key is null where the vector takes no part."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"))
    return rows.withColumn("key", F.when(usable(F.col("vec")), vector_key(F.col("vec"))))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a double matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
