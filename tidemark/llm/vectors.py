"""Packed unit vectors: the form in which vectors are kept and moved."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMS = 64


def pack(ids: pa.Array, vectors: pa.Array, dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the usable vectors of a list column, and those at length 1 (float32)."""
    ok = pc.and_(pc.is_valid(ids), pc.equal(pc.fill_null(pc.list_value_length(vectors), 0), dims))
    at = np.flatnonzero(ok.to_numpy(zero_copy_only=False))
    if not len(at):
        return at, np.zeros((0, dims), np.float32)
    flat = pc.list_flatten(vectors.take(pa.array(at)))
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)  # nulls become NaN
    top = np.abs(x).max(axis=1)
    good = np.isfinite(top) & (top > 0) & np.isfinite(x).all(axis=1)
    x, at = x[good] / top[good, None], at[good]
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    return at, x.astype(np.float32)


def to_binary(x: np.ndarray) -> pa.Array:
    """Rows of a float32 matrix as fixed runs of bytes."""
    n, width = len(x), x.shape[1] * 4
    offsets = pa.array(np.arange(n + 1, dtype=np.int64) * width, pa.int32())
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, offsets.buffers()[1], pa.py_buffer(np.ascontiguousarray(x, np.float32).tobytes())])


def from_binary(column: pa.Array, dims: int = DIMS) -> np.ndarray:
    """The inverse of :func:`to_binary`."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if not len(column):
        return np.zeros((0, dims), np.float32)
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dims)


def unit_vectors(df: DataFrame, id_col: str = "datum_id", vec_col: str = "float_data", extra: list[str] | None = None, dims: int = DIMS) -> DataFrame:
    """``id`` (long), the ``extra`` columns and ``vec`` (unit vector, packed) of the usable rows.

    A vector is usable if it has ``dims`` finite values that aren't all zero.
    Rows without a usable vector or with a null id are left out. Repeated ids
    stay repeated; the consumers drop them where rows of one id meet anyway.
    """
    extra = extra or []
    schema = "id bigint, " + "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in extra) + "vec binary"

    def run(batches):
        for b in batches:
            at, x = pack(b.column(0), b.column(1), dims)
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), *[b.column(2 + i).take(take) for i in range(len(extra))], to_binary(x)], ["id", *extra, "vec"])

    narrow = df.select(F.col(f"`{id_col}`").cast("bigint"), F.col(f"`{vec_col}`").cast("array<float>"), *[F.col(f"`{c}`") for c in extra])
    return narrow.where(f"size(`{vec_col}`) = {dims}").mapInArrow(run, schema)
