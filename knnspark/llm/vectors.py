"""What the vector operators share: which vectors take part, and Arrow access to them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    wide = vector.cast("array<double>")
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(wide, lambda x: x != 0)


def matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as rows, in double precision; unequal lengths are an error."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if len(pc.unique(pc.list_value_length(col))) > 1:
        raise ValueError("vectors must have equal lengths")
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 0)


def plain(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"))
