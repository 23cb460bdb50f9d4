"""Quantised vectors: what the operators on embeddings share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps of a unit; a component c becomes floor(STEPS * c).
STEPS = 256
#: Whole numbers up to this are exact as doubles.
EXACT = 1 << 53


def is_finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""

    def good(c: Column) -> Column:
        c = c.cast("double")
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))

    return vector.isNotNull() & F.coalesce(F.forall(vector, good), F.lit(False))


def quantised(vector: Column) -> Column:
    """The components as whole numbers."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * STEPS).cast("long"))


def usable(rows: DataFrame, *more: Column, vector: str = "embedding") -> DataFrame:
    """``more`` and ``x``, the quantised vector, of the rows with a finite vector; shorter ones are filled up with zeros."""
    own = rows.where(is_finite(F.col(vector)))
    least, most = own.agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
    x = quantised(F.col(vector))
    if least != most:
        x = F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(most) - F.size(vector)))
    return own.select(*more, x.alias("x"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A column of whole-number lists as a matrix; a shorter list is filled with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def in_batches(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``rows``, the last ones of a task fewer."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - n)
            batch = batch.slice(part.num_rows)
            held.append(part)
            n += part.num_rows
            if n == rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
