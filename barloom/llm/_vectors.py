"""Vectors as whole numbers: which rows take part, and batches of them as NumPy matrices."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def limit(dims: int) -> int:
    """The largest absolute component for which squared distances in ``dims`` dimensions stay far within 64 bits."""
    return min(1 << 30, math.isqrt((1 << 62) // max(1, dims)) // 2)


def usable(column: str = "embedding") -> Column:
    """Whether a vector is there and holds neither null nor non-finite components."""
    fine = F.forall(F.col(column).cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(column).isNotNull() & F.coalesce(fine, F.lit(False))


def whole(dims: int, scale: int, column: str = "embedding") -> Column:
    """floor(scale * x) of every component, x as double; null for another length than ``dims`` and beyond limit(dims)."""
    v = F.transform(F.col(column).cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))))
    within = F.forall(F.col(column).cast("array<double>"), lambda x: F.abs(x * F.lit(float(scale))) < float(limit(dims)))
    return F.when((F.size(column) == dims) & within, v.cast("array<int>"))


def matrix(column, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows with a vector, their components row by row) of an Arrow list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = np.flatnonzero(np.asarray(column.is_valid()))
    flat = np.asarray(column.flatten())  # null lists hold nothing there
    return rows, flat.reshape(len(rows), dims)


def first(rows: DataFrame, n: int, *order: Column) -> list[list[int]]:
    """The vectors ``v`` of the first n rows; equal rows by their components."""
    return [r.v for r in rows.where("v is not null").orderBy(*order, "v").limit(n).select("v").collect()]
