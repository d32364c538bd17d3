"""Start values and the update step of one layer (model-sized work on the driver)."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from layerstack.operators.blocks import sparsity
from layerstack.operators.randoms import WEIGHT_SEED, Lcg48
from layerstack.operators.rules import Rules

__all__ = ["Descent", "averaged", "initial_decoder", "initial_encoder", "sparsity"]

# Floor for the norm that divides the learning rate, under the standard semantics.
NORM_FLOOR = 1e-12


def initial_encoder(n: int, k: int, rules: Rules, seed: int, layer: int) -> np.ndarray:
    """Gaussian weights of variance 1/n, bias row 0."""
    w = np.zeros((n + 1, k))
    if rules.same_init:
        draws = Lcg48(WEIGHT_SEED).normals((n + 1) * k) * np.sqrt(1.0 / n)
        w[1:] = draws.reshape(k, n + 1).T[1:]
    else:
        w[1:] = np.random.default_rng([seed, layer]).normal(size=(n, k)) * np.sqrt(1.0 / n)
    return w


def initial_decoder(w: np.ndarray) -> np.ndarray:
    """The encoder's weights transposed, bias row 0."""
    s = np.zeros((w.shape[1] + 1, w.shape[0] - 1))
    s[1:] = w[1:].T
    return s


def averaged(gradient: np.ndarray, theta: np.ndarray, rows: float, lmbda: float) -> np.ndarray:
    """Mean gradient plus the L2 term, which leaves the bias row alone."""
    d = gradient / rows
    d[1:] += lmbda * theta[1:]
    return d


@dataclass
class Descent:
    """One matrix under gradient descent whose step is the learning rate divided by the norm of
    all averaged gradients so far, added up."""

    theta: np.ndarray
    learning: float
    lmbda: float
    rules: Rules
    total: np.ndarray = field(default=None)

    def __post_init__(self) -> None:
        if self.total is None:
            self.total = np.zeros_like(self.theta)

    def step(self, gradient: np.ndarray, rows: float) -> None:
        d = averaged(gradient, self.theta, rows, self.lmbda)
        self.total += d
        norm = float(np.sqrt((self.total**2).sum()))
        if not self.rules.guard:
            with np.errstate(divide="ignore", invalid="ignore"):
                rate = np.float64(self.learning) / norm
        else:
            rate = self.learning / max(norm, NORM_FLOOR)
        theta = self.theta.copy()
        if self.rules.decay:
            theta[1:] *= 1 - rate * self.lmbda / rows
        theta = theta - rate * d
        if self.rules.guard and not np.isfinite(theta).all():
            raise ArithmeticError("weights are no longer finite: lower the learning rate or beta")
        self.theta = theta
