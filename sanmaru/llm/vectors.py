"""Vectors of whole numbers: which rows take part, how components become integers, and matrices of Arrow lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """True where a vector is there and all its components are finite numbers."""
    fine = F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def integers(vectors: DataFrame, scale: float, id_col: str, vector_col: str, *others: Column) -> DataFrame:
    """``vec_id, others, x`` of the rows whose vector is finite; ``x`` holds ``floor(scale * component)`` as longs."""
    x = F.transform(F.col(vector_col), lambda e: F.floor(F.lit(scale) * e.cast("double")))
    return vectors.filter(finite(F.col(vector_col))).select(F.col(id_col).cast("long").alias("vec_id"), *others, x.alias("x"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of integers as rows of ``dim`` numbers; shorter ones end in zeros."""
    sizes = np.asarray(column.value_lengths().fill_null(0))
    flat = np.asarray(column.flatten(), dtype=np.int64)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out
