"""Helpers for embedding columns."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def usable(vector: Column) -> Column:
    """True if a vector is not null or empty, holds only finite numbers and is not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def stacked(vectors: Iterable) -> np.ndarray:
    """Vectors of one length as the rows of a matrix of doubles."""
    return np.stack([np.asarray(v, np.float64) for v in vectors])


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled by their largest entry first, so that no square overflows."""
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def sampled(df: DataFrame, key: str, rows: int) -> pd.DataFrame:
    """The ``rows`` rows of the smallest hash of ``key``, on the driver: the same ones in every run."""
    return df.orderBy(F.xxhash64(key, F.lit(11)), key).limit(rows).toPandas()
