"""What the vector operators share: which vectors take part, samples, and Arrow to numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components, and not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    """Rows of an array column, all of one length."""
    if not len(column):
        return np.empty((0, 0), kind)
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; first by their largest component, so squares neither vanish nor overflow."""
    if not x.size:
        return x
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def sample(vectors: DataFrame, key: str, vector: str, most: int) -> np.ndarray:
    """At most `most` vectors, chosen by a hash of their key; a fixed bound, whatever the table's size."""
    rows = vectors.orderBy(F.xxhash64(key, F.lit(11)), key).limit(most).select(F.col(vector).cast("array<double>").alias("v")).toArrow()
    return unit(matrix(rows.column("v").combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.float64()))))


def dimension(vectors: DataFrame, vector: str) -> int:
    """The commonest length of the vectors (ties: the longer); 0 without vectors."""
    found = vectors.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found["d"] if found else 0


def component_kind(vectors: DataFrame, vector: str) -> str:
    """float or double: what the vectors are kept as; other numbers are kept as double."""
    return "float" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "double"
