"""Vector rows that take part in searches and joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``keys`` and ``x`` (array<double>) of rows whose vector is not null, not empty, not zero and wholly finite.

    Vectors may have several lengths; those of different lengths aren't compared.
    """
    x = F.col(column).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    some = F.exists(x, lambda v: v != 0)
    return rows.filter(F.col(keys[0]).isNotNull() & x.isNotNull() & ~bad & some).select(*keys, x.alias("x"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of equally long vectors as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)
