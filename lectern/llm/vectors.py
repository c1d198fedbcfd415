"""What the operators on vectors share: usable vectors, their integer form, and rows of numbers packed as bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector is not null and has finite components only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def grid(vector: Column, scale: int) -> Column:
    """Each component x as the integer floor(scale * x), x as double. Products beyond 2^63 end at its bounds."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def width(df: DataFrame, vector: str) -> int:
    """The greatest length of a vector; shorter ones count as filled with zeros."""
    return df.agg(F.max(F.size(vector))).first()[0] or 0


def matrix(column: pa.Array | pa.ChunkedArray, columns: int) -> np.ndarray:
    """A column of integer lists as a matrix; lists that are shorter are filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, lengths = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    if len(flat) == len(column) * columns and (lengths == columns).all():
        return flat.reshape(-1, columns)
    out = np.zeros((len(column), columns), dtype=np.int64)
    out[np.arange(columns) < lengths[:, None]] = flat
    return out


def packed(numbers: np.ndarray) -> bytes:
    """Integers as little-endian bytes, of 32 bits where these hold them and else of 64; the first byte tells which."""
    fits = not numbers.size or (numbers.min() >= -(1 << 31) and numbers.max() < 1 << 31)
    return (b"\x04" if fits else b"\x08") + np.ascontiguousarray(numbers, dtype="<i4" if fits else "<i8").tobytes()


def unpacked(raw: bytes, columns: int | None = None) -> np.ndarray:
    """The integers of packed() as 64 bits, as a matrix if the number of columns is given."""
    numbers = np.frombuffer(raw, dtype="<i4" if raw[0] == 4 else "<i8", offset=1).astype(np.int64)
    return numbers if columns is None else numbers.reshape(-1, columns)


def exact_in_double(*matrices: np.ndarray) -> bool:
    """Whether inner products of rows of the matrices are exact in double precision, which is far faster than integers."""
    most = [max((abs(int(m.min())), abs(int(m.max())))) if m.size else 0 for m in matrices]
    return most[0] * most[-1] * max(1, matrices[0].shape[1]) < 1 << 53
