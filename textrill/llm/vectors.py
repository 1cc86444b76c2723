"""Reading vectors in tasks: which rows take part, and their components as bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType


def usable(vector: Column) -> Column:
    """Not null, not empty, only finite components, not all of them zero."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, odd) & F.exists(vector, lambda x: x != 0)


def matrix(lists: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix of doubles."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1)


def component_type(vectors: DataFrame) -> str:
    """How the components of the column ``vec`` are kept as bytes without loss."""
    return "<f4" if vectors.schema["vec"].dataType.elementType == FloatType() else "<f8"


def packed(rows: np.ndarray, kind: str) -> list[bytes]:
    return [r.tobytes() for r in np.ascontiguousarray(rows, kind)]


def unpacked(column: pa.Array, kind: str) -> np.ndarray:
    """A column of binaries of one length as a matrix; numbers of single precision become doubles."""
    found = np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)
    return found.astype(np.float64) if kind == "<f4" else found
