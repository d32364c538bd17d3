"""Row-wise functions from vectors to vectors, as scalar Arrow UDFs.

Higher-order functions on arrays run interpreted in Spark; on whole tables of vectors a matrix
operation per Arrow batch is several times faster and still lets Catalyst prune and push down.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def _lists(y: np.ndarray) -> pa.Array:
    rows, width = y.shape
    offsets = np.arange(rows + 1, dtype="i4") * width
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(y.ravel().astype("f8", copy=False)))


def complete(column: pa.Array) -> np.ndarray:
    """Which vectors are there and hold no null element (ML vectors, which are structs, have none)."""
    flags = np.array(column.is_valid())
    if pa.types.is_struct(column.type):
        return flags
    values = column.flatten()
    if values.null_count:
        flags[pc.list_parent_indices(column).to_numpy()[np.array(values.is_null())]] = False
    return flags


def skip_nulls(
    column: pa.Array, f: Callable[..., pa.Array], *others: pa.Array
) -> pa.Array:
    """Apply f to the rows whose vector is complete; null vectors, and vectors with a null element,
    give null."""
    flags = complete(column)
    if flags.all():
        return f(column, *others)
    valid = pa.array(flags)
    place = pa.array(np.where(flags, np.cumsum(flags) - 1, 0), mask=~flags)
    return f(column.filter(valid), *(o.filter(valid) for o in others)).take(place)


def vector_udf(make: Callable[[pa.Array], np.ndarray], x: Column) -> Column:
    """Array column of `make(column)`, a matrix with one row per input row."""

    @F.arrow_udf("array<double>")
    def run(v: pa.Array) -> pa.Array:
        return skip_nulls(v, lambda c: _lists(make(c)))

    return run(x)


def keyed_vector_udf(
    make: Callable[[pa.Array, pa.Array], np.ndarray], x: Column, key: Column
) -> Column:
    """The same with a key column."""

    @F.arrow_udf("array<double>")
    def run(v: pa.Array, k: pa.Array) -> pa.Array:
        return skip_nulls(v, lambda c, d: _lists(make(c, d)), k)

    return run(x, key)
