"""Whole-number vectors from an array column, shared by the vector operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256


def usable(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(fine, F.lit(False))


def whole_components(vector: str) -> Column:
    """floor(256 * x) of every component, x as double."""
    return F.transform(F.col(vector), lambda v: F.floor(F.lit(float(SCALE)) * v.cast("double")))


def widest(df: DataFrame, vector: str) -> int:
    """Most components of a vector; shorter ones count as padded with zeros."""
    return df.agg(F.max(F.size(vector))).first()[0] or 0


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a batch as rows of a 64-bit matrix, padded with zeros."""
    ends = np.asarray(column.offsets, dtype=np.int64)
    flat = np.asarray(column.values, dtype=np.int64)
    sizes = np.diff(ends)
    if len(sizes) and sizes.min() == sizes.max() == width:
        return flat[ends[0] : ends[-1]].reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(row)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat[ends[0] : ends[-1]]
    return out


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products ``a @ b.T`` of whole numbers; by floating point where that can't round."""
    most = float(max(abs(int(a.max(initial=0))), abs(int(a.min(initial=0))))) * float(max(abs(int(b.max(initial=0))), abs(int(b.min(initial=0)))))
    if most * max(a.shape[-1], 1) < 2.0**53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T
