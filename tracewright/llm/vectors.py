"""What the operators on embedding vectors share: which vectors take part, and arrays from batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid(df: DataFrame, id_col: str, vector: str, zero: bool = True) -> DataFrame:
    """(id, v): the rows whose vector is an array of finite numbers, as doubles. ``zero``: zero vectors too."""
    d = df.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    d = d.filter(F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(finite, F.lit(False)))
    return d if zero else d.filter(F.exists("v", lambda c: c != 0))


def dimension(vectors: DataFrame) -> int:
    """The most frequent length of ``v`` (the least of several); 0 for an empty table."""
    r = vectors.groupBy(F.size("v").alias("k")).count().orderBy(F.desc("count"), "k").first()
    return r["k"] if r else 0


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The rows of an Arrow column of lists, all of length ``dim``, as an array."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
