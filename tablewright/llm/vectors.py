"""Embeddings that can take part in a search: one per id, finite, not zero, of one length."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v) of the vectors that take part.

    Vectors that are null, empty or zero or hold nulls or values that are not finite do not, nor do
    rows without an id or with a length other than the most frequent one (the longer of two). Of
    several vectors with one id the smallest takes part.
    """
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.col("count").desc(), F.col("n").desc()).limit(1).collect()
    length = lengths[0]["n"] if lengths else 0
    return rows.where(F.size("v") == length).groupBy("id").agg(F.min("v").alias("v"))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of lists of one length as rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def padded(column: pa.Array | pa.ChunkedArray, kind: type = np.float64, width: int | None = None, fill: int = 0) -> np.ndarray:
    """A column of lists as rows of a matrix, ``width`` or as wide as the longest; ``fill`` ends shorter ones."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    width = int(lengths.max(initial=0)) if width is None else width
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    rows = np.full((len(lengths), width), fill, kind)
    rows[np.arange(width) < lengths[:, None]] = flat
    return rows
