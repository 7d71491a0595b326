"""Vectors as rows of one matrix block: parsing, pivots, and grouping of blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, id_col: str, vector_col: str, nonzero: bool) -> DataFrame:
    """(vec_id, x) of the vectors that take part: not null, no null or non-finite component, for cosine not all zero.

    An id that repeats counts once, with the least of its vectors. Rows without an id are left out.
    """
    x = F.col("x")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    ok = x.isNotNull() & F.forall(x, finite)
    if nonzero:
        ok = ok & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    return rows.where(F.col("vec_id").isNotNull() & ok).groupBy("vec_id").agg(F.min("x").alias("x"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as doubles; shorter rows end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("f8")
    if (n == width).all():
        return flat.reshape(len(n), width)
    out = np.zeros((len(n), width))
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def pack(rows: np.ndarray) -> pa.Array:
    """A fixed number of bytes for each row of a matrix."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype="i4") * width), pa.py_buffer(rows)])


def unpack(column, width: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=kind).reshape(-1, width) if len(column) else np.empty((0, width), kind)


def sample(rows: DataFrame, n: int, width: int) -> np.ndarray:
    """n vectors, those whose ids have the smallest hashes: a set whose size is a parameter, whatever the input's."""
    got = rows.select("x", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(n).collect()
    return matrix(pa.array([r.x for r in got], pa.list_(pa.float64())), width)


def pivots(seen: np.ndarray, n: int) -> np.ndarray:
    """n of the vectors, chosen by spread: the first, then always the one farthest from those chosen."""
    far, out = np.full(len(seen), np.inf), [0]
    while len(out) < min(n, len(seen)):
        far = np.minimum(far, ((seen - seen[out[-1]]) ** 2).sum(1))
        out.append(int(far.argmax()))
    return seen[out]


def tiles(n: int, most: int) -> Iterator[slice]:
    for i in range(0, n, most):
        yield slice(i, min(n, i + most))
