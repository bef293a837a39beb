"""Vectors of list columns as matrices, unit vectors, bounded samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_HASH_PARTS = 1 << 20


def vector_column(table: DataFrame, name: str) -> Column:
    """A vector column by name: float lists stay so, anything else becomes a list of doubles."""
    if name in table.columns:
        kind = table.schema[name].dataType
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType):
            return F.col(f"`{name}`")
        return F.col(f"`{name}`").cast("array<double>")
    return F.lit(None).cast("array<double>")


def is_finite(v: Column) -> Column:
    """The vector is there, not empty, and holds finite numbers only."""
    every = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & every, F.lit(False))


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix of doubles) for each width among the lists of a column without nulls."""
    widths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        own = column if len(rows) == len(column) else column.take(pa.array(rows))
        flat = own.flatten().to_numpy(zero_copy_only=False)
        yield rows, flat.astype(np.float64).reshape(len(rows), int(width))


def units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled by powers of two to entries of about one, and the same rows at length one."""
    most = np.abs(x).max(axis=1, keepdims=True)
    scaled = np.ldexp(x, -np.frexp(most)[1])
    return scaled, scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def hash_sample(df: DataFrame, key: str, total: int, rows: int) -> list:
    """About ``rows`` rows of ``total``, the same in every run, never more than twice as many."""
    if total > rows:
        share = max(1, min(_HASH_PARTS, rows * _HASH_PARTS // total))
        df = df.filter(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(_HASH_PARTS)) < share)
    return df.limit(2 * rows).collect()
