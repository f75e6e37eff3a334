"""What the operators on vectors share: which rows take part, and matrices from Arrow lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_finite(vec: Column) -> Column:
    """True for an array without null, NaN or infinite entries; False for any other and for null."""
    entry = lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(x.cast("double"))
    return F.coalesce(F.forall(vec, entry), F.lit(False))


def same_length(rows: DataFrame, vec: str) -> tuple[DataFrame, int, int]:
    """``(rows, dimensions, count)``: the rows whose vectors have the most frequent length (the greatest of equals).

    Vectors of other lengths have no place in the same space; empty vectors never count.
    """
    sizes = rows.groupBy(F.size(vec).alias("d")).count().where("d > 0")
    top = sizes.orderBy(F.desc("count"), F.desc("d")).first()
    if top is None:
        return rows.where(F.lit(False)), 0, 0
    return rows.where(F.size(vec) == top["d"]), top["d"], top["count"]


def matrix(col: pa.Array, dims: int) -> np.ndarray:
    """A list column of full rows as a (rows, dims) array of doubles."""
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dims)
