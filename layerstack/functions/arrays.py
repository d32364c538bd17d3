"""Vector operations on array columns, for use inside SQL plans.

They are meant for narrow vectors and ad-hoc queries: higher-order functions run
interpreted, element by element. `layerstack.operators` does the same work on matrix
blocks and is the way to process whole tables of wide vectors.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from layerstack.functions.activations import _col, clamp_probability


def with_bias(x: Column | str) -> Column:
    """Put the bias input 1.0 in front of a vector."""
    return F.concat(F.array(F.lit(1.0)), _col(x))


def without_bias(x: Column | str) -> Column:
    """Drop the leading bias element of a vector."""
    return F.slice(_col(x), F.lit(2), F.greatest(F.size(_col(x)) - 1, F.lit(0)))


def dot(x: Column | str, y: Column | str) -> Column:
    products = F.zip_with(_col(x), _col(y), lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def vector_times_matrix(x: Column | str, matrix: np.ndarray) -> Column:
    """`x @ matrix` for an array column and a literal matrix."""
    columns = np.asarray(matrix, dtype="f8").T
    return F.array(*[dot(x, F.array(*[F.lit(float(v)) for v in c])) for c in columns])


def residual(predicted: Column | str, target: Column | str) -> Column:
    return F.zip_with(_col(predicted), _col(target), lambda p, t: p - t)


def cross_entropy(target: Column | str, predicted: Column | str) -> Column:
    """Summed binary cross-entropy of two vectors, with the predictions clamped."""

    def term(t: Column, p: Column) -> Column:
        c = clamp_probability(p)
        return -(t * F.log(c) + (1 - t) * F.log(1 - c))

    terms = F.zip_with(_col(target), _col(predicted), term)
    return F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v)
