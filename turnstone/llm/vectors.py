"""What the operators on vectors share: reading vectors out of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema


def finite(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The vectors of a list column that hold finite components only, as one float64 matrix
    per dimension with the row numbers they come from. Null vectors, empty vectors and those
    with a null, NaN or infinite component are left out."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null becomes NaN
    starts = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == dim)
        matrix = flat[starts[rows][:, None] + np.arange(dim)]
        good = np.isfinite(matrix).all(axis=1)
        if good.any():
            yield rows[good], matrix[good]


def grid(matrix: np.ndarray, scale: int, bound: int) -> np.ndarray:
    """floor(scale * x) as integers. Raises where a component is over ``bound`` in size:
    squared distances would not fit a long."""
    out = np.floor(scale * matrix)
    if out.size and np.abs(out).max() > bound:
        raise ValueError(f"a vector component is beyond {bound // scale}: its squared distances do not fit a long")
    return out.astype(np.int64)


def arrow(schema: T.StructType) -> pa.Schema:
    return to_arrow_schema(schema)


def struct(schema: pa.Schema) -> T.StructType:
    return from_arrow_schema(schema)
