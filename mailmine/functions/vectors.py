"""Vector arithmetic on ``array<float>`` / ``array<double>`` columns.

Products of whole rows run on Arrow batches with NumPy; sums over rows use the
JVM summarizer, which combines on the map side.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# similarities are compared after rounding, so that the order in which a sum
# was built can not change a rank
SIM_DIGITS = 9


def matrix(column: pa.Array) -> np.ndarray:
    """A list column as a matrix, in double; a null, an empty value or an uneven length is an error."""

    lengths = column.value_lengths()
    if column.null_count or len(lengths.unique()) > 1 or column.flatten().null_count:
        raise ValueError(f"{column.null_count} null vectors, lengths {lengths.unique().to_pylist()[:5]}, "
                         f"{column.flatten().null_count} null elements")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _whole(kernel: Callable, *columns: pa.Array) -> pa.Array:
    """``kernel`` over the rows whose vectors are all set; null in, null out."""

    valid = np.ones(len(columns[0]), bool)
    for c in columns:
        valid &= ~np.asarray(c.is_null())
    if valid.all():
        return kernel(*columns)
    place = np.where(valid, np.cumsum(valid) - 1, 0)
    found = kernel(*(c.filter(pa.array(valid)) for c in columns))
    return found.take(pa.array(place, mask=~valid))


@F.arrow_udf(T.DoubleType())
def dot(a: pa.Array, b: pa.Array) -> pa.Array:
    """Dot product in double."""

    return _whole(lambda x, y: pa.array((matrix(x) * matrix(y)).sum(axis=1)), a, b)


@F.arrow_udf(T.DoubleType())
def squared_norm(a: pa.Array) -> pa.Array:
    return _whole(lambda x: pa.array((matrix(x) ** 2).sum(axis=1)), a)


@F.arrow_udf(T.DoubleType())
def distance(a: pa.Array, b: pa.Array) -> pa.Array:
    """Euclidean distance."""

    return _whole(lambda x, y: pa.array(np.sqrt(((matrix(x) - matrix(y)) ** 2).sum(axis=1))), a, b)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two unit vectors, clipped to [-1, 1]."""

    return F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b))), SIM_DIGITS)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def l2_normalize(a: pa.Array) -> pa.Array:
    """Unit length; a zero vector stays as it is."""

    return _whole(_unit_rows, a)


def _unit_rows(a: pa.Array) -> pa.Array:
    rows = matrix(a)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    norms[norms == 0] = 1.0
    width = rows.shape[1]
    offsets = pa.array(np.arange(len(a) + 1, dtype=np.int32) * width)
    return pa.ListArray.from_arrays(offsets, pa.array((rows / norms).ravel()))


def scaled(a: Column, factor: Column) -> Column:
    """Each element times a factor; for tables of one row per cluster."""

    return F.transform(a, lambda x: x.cast("double") * factor)


def sum_vector(vector: Column) -> Column:
    """Element-wise sum of a group as ``array<double>``."""

    return vector_to_array(Summarizer.sum(array_to_vector(vector)))
