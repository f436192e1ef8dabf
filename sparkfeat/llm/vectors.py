"""Embedding rows as integer vectors, and Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def integer_vectors(df: DataFrame, *, id_col: str, vec_col: str, scale: float, offset: int = 0,
                    limit: int = 2**31 - 1, **more: Column) -> tuple[DataFrame, int]:
    """(rows of ``vec_id``, ``x`` and the columns ``more``; number of dimensions): each component c,
    as double, becomes floor(scale * c) + offset.

    A row takes no part if its vector is null, holds a null or non-finite component or one whose
    integer lies beyond ``limit``, or has another length than most vectors have (equally frequent:
    the longer one). Of no usable row the number of dimensions is 0."""
    v = F.col(vec_col).cast("array<double>")
    bound = (limit - abs(offset) - 1) / scale
    usable = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & (F.abs(c) <= F.lit(bound)))
    x = F.transform(v, lambda c: (F.floor(c * F.lit(float(scale))) + F.lit(offset)).cast("int" if limit < 2**31 else "long"))
    # the condition stands inside the expression: a filter alone may be evaluated after it
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.when(usable, x).alias("x"),
                     *(c.alias(name) for name, c in more.items())).where("x is not null")
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dims = length["d"] if length else 0
    return rows.where((F.size("x") == dims) & (F.lit(dims) > 0)), dims


def matrix(column: pa.Array, dims: int, dtype=np.int64) -> np.ndarray:
    """The rows of a list column, all of ``dims`` entries, as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):                          # of no chunk
        return np.zeros((0, dims), dtype)
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), dims)


def lists(m: np.ndarray) -> pa.Array:
    """The rows of a matrix as a list column."""
    m = np.ascontiguousarray(m)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.ravel()))
