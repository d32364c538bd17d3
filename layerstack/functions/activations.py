"""Activation functions, their derivatives and the sparsity terms as Spark columns.

Every function takes a column (or its name) of doubles and stays inside whole-stage
codegen. `over_array` lifts any of them to an array column. NULL gives NULL; NaN gives what the
formulas give in floating point, where NaN is neither above nor below 0 (Spark orders it above all).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Slopes of the leaky and exponential units and the probability clamp.
LEAKY_SLOPE = 0.01
ELU_SCALE = 0.05
CLAMP = 1e-14


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sigmoid(x: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(x)))


def dsigmoid(x: Column | str) -> Column:
    s = sigmoid(x)
    return s * (F.lit(1.0) - s)


def tanh(x: Column | str) -> Column:
    return F.tanh(_col(x))


def dtanh(x: Column | str) -> Column:
    t = F.tanh(_col(x))
    return F.lit(1.0) - t * t


def relu(x: Column | str) -> Column:
    return F.when(_col(x) >= 0, _col(x)).when(_col(x) < 0, 0.0)


def _step(x: Column | str, nan: float | Column, below: float | Column) -> Column:
    """1 from 0 on; NULL stays NULL, which `otherwise` alone would swallow."""
    x = _col(x)
    return F.when(F.isnan(x), nan).when(x >= 0, 1.0).when(x < 0, below)


def drelu(x: Column | str) -> Column:
    return _step(x, 0.0, 0.0)


def lrelu(x: Column | str) -> Column:
    return F.when(_col(x) >= 0, _col(x)).otherwise(_col(x) * LEAKY_SLOPE)


def dlrelu(x: Column | str) -> Column:
    return _step(x, LEAKY_SLOPE, LEAKY_SLOPE)


def elu(x: Column | str) -> Column:
    return F.when(_col(x) >= 0, _col(x)).otherwise(F.expm1(_col(x)) * ELU_SCALE)


def delu(x: Column | str) -> Column:
    return _step(x, float("nan"), F.exp(_col(x)) * ELU_SCALE)


def clamp_probability(x: Column | str) -> Column:
    """Keep a probability away from 0 and 1, so that its logarithm exists.

    Needed on Spark in particular: `ln(0)` is NULL there and sums skip NULL. NaN and NULL stay.
    """
    x = _col(x)
    return (
        F.when(F.isnan(x), x)
        .when(x < CLAMP, CLAMP)
        .when(x > 1.0 - CLAMP, 1.0 - CLAMP)
        .otherwise(x)
    )


def _over(a: float, b: Column) -> Column:
    """a / b for a of at least 0 and b of at least 0, infinite (NaN for 0 / 0) where b is 0."""
    return F.when(b == 0, float("inf") if a else float("nan")).otherwise(a / b)


def _log(x: Column) -> Column:
    """Logarithm that keeps the infinities, which `ln` turns into NULL at 0."""
    return F.when(x == 0, float("-inf")).otherwise(F.log(x))


def kl_term(pj: Column | str, target: float, guard: bool = True) -> Column:
    """Kullback-Leibler distance of a unit's mean activation from the target.

    With `guard` the mean is kept off 0 and 1, so a dead or saturated unit has a finite distance;
    without, it has an infinite one.
    """
    p = clamp_probability(pj) if guard else _col(pj)
    return target * _log(_over(target, p)) + (1 - target) * _log(_over(1 - target, F.lit(1.0) - p))


def kl_gradient(pj: Column | str, target: float, beta: float = 1.0, guard: bool = True) -> Column:
    """Derivative of `beta * kl_term` with respect to the mean activation."""
    p = clamp_probability(pj) if guard else _col(pj)
    return beta * (_over(1 - target, F.lit(1.0) - p) - _over(target, p))


def over_array(f: Callable[[Column], Column], x: Column | str) -> Column:
    """Apply a scalar column function to every element of an array column."""
    return F.transform(_col(x), f)


ACTIVATIONS = {
    "sigmoid": (sigmoid, dsigmoid),
    "tanh": (tanh, dtanh),
    "relu": (relu, drelu),
    "lrelu": (lrelu, dlrelu),
    "elu": (elu, delu),
}
