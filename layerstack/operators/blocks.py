"""Forward and backward passes of one layer on one block of rows.

A block is an (m, n) matrix of m rows. `W` is (n + 1, k), `S` is (k + 1, n), each with the
bias in row 0. These are the small numeric steps that run inside Spark tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from layerstack.functions.activations import CLAMP, ELU_SCALE, LEAKY_SLOPE
from layerstack.operators.randoms import fixed_mask, hash_mask, mask_at, mask_rows
from layerstack.operators.rules import Rules
from layerstack.operators.sparse import SPARSE_SHARE, SparseInput


def features_block(column: pa.Array, width: int) -> np.ndarray:
    """Arrow list column -> (rows, width) matrix; refuses nulls and other widths."""
    rows = len(column)
    values = column.flatten()
    if column.null_count or values.null_count:
        raise ValueError("features hold nulls")
    sizes = np.diff(column.offsets.to_numpy())
    if rows and (sizes != width).any():
        raise ValueError(f"every row must have {width} features, found {set(sizes.tolist())}")
    return values.to_numpy(zero_copy_only=False).reshape(rows, width)


def bounded(x: np.ndarray, outside: str) -> np.ndarray:
    """Scaled features under the rule for values outside [0, 1], where cross-entropy has no meaning:
    `keep` them, `clip` them, or end with an `error`. NaN passes."""
    if outside == "clip":
        return np.clip(x, 0.0, 1.0)
    if outside == "error" and ((x < 0) | (x > 1)).any():
        raise ValueError("features lie outside the trained range; see the option outside")
    return x


def scale_block(x: np.ndarray, ranges: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """Doubles scaled by (lo, hi) ranges; a constant feature becomes 0."""
    if ranges is None:
        return x.astype("f8", copy=False)
    lo, hi = ranges
    span = hi - lo
    flat = span == 0
    y = x - lo
    y /= np.where(flat, 1.0, span)
    if flat.any():
        y[:, flat] = 0.0
    return y


def sigmoid(z: np.ndarray) -> np.ndarray:
    y = np.negative(z)
    with np.errstate(over="ignore"):
        np.exp(y, out=y)
    y += 1.0
    return np.reciprocal(y, out=y)


def activate(z: np.ndarray, name: str) -> np.ndarray:
    if name == "sigmoid":
        return sigmoid(z)
    if name == "tanh":
        return np.tanh(z)
    if name == "relu":
        return np.maximum(z, 0.0)
    if name == "lrelu":
        return np.where(z >= 0, z, LEAKY_SLOPE * z)
    if name == "elu":
        return np.where(z >= 0, z, ELU_SCALE * np.expm1(np.minimum(z, 0.0)))
    raise ValueError(f"unknown activation {name!r}")


def slope(z: np.ndarray, h: np.ndarray, name: str) -> np.ndarray:
    """Derivative of the activation, from its input z and its output h."""
    if name == "sigmoid":
        return h * (1.0 - h)
    if name == "tanh":
        return 1.0 - h * h
    if name == "relu":
        return np.where(z >= 0, 1.0, 0.0)
    if name == "lrelu":
        return np.where(z >= 0, 1.0, LEAKY_SLOPE)
    if name == "elu":
        return np.where(z >= 0, 1.0, ELU_SCALE * np.exp(np.minimum(z, 0.0)))
    raise ValueError(f"unknown activation {name!r}")


def cross_entropy(t: np.ndarray, p: np.ndarray, guard: bool) -> np.ndarray:
    """Cross-entropy of every value; the caller sums it, by row or over all."""
    if guard:
        p = np.clip(p, CLAMP, 1.0 - CLAMP)
    off = 1.0 - p
    with np.errstate(divide="ignore", invalid="ignore"):
        on = np.log(p)
        np.log(off, out=off)
        on *= t
        off *= 1.0 - t
        on += off
    return np.negative(on, out=on)


@dataclass(frozen=True)
class LayerSpec:
    """What one pass over one layer has to know besides its weights."""

    method: str
    rules: Rules
    activation: str = "sigmoid"
    tied: bool = False
    corruption: float = 0.5
    seed: int = 0
    layer: int = 1
    epoch: int = 0

    @property
    def keyed(self) -> bool:
        """Whether rows need a stable key (the mask is drawn per row)."""
        return self.method == "denoising" and not self.rules.fixed_mask

    def mask(self, keys: np.ndarray | None, width: int) -> np.ndarray | None:
        if self.method != "denoising":
            return None
        if self.rules.fixed_mask:
            return fixed_mask(width)
        return hash_mask(keys, width, self.corruption, self.layer, self.epoch, self.seed)


def filled(x: np.ndarray | SparseInput) -> np.ndarray:
    """A block as a matrix."""
    return x.dense() if isinstance(x, SparseInput) else x


def encode_layer(x: np.ndarray | SparseInput, w: np.ndarray, spec: LayerSpec) -> np.ndarray:
    """Codes of a finished layer. Only the fixed mask stays on outside training."""
    if isinstance(x, SparseInput):
        if spec.method == "denoising" and spec.rules.fixed_mask:
            w = np.concatenate([w[:1], w[1:] * fixed_mask(x.shape[1])[:, None]])
        return activate(x.times(w[1:]) + w[0], spec.activation)
    if spec.method == "denoising" and spec.rules.fixed_mask:
        x = x * fixed_mask(x.shape[1])
    return activate(x @ w[1:] + w[0], spec.activation)


def decode_input(h: np.ndarray, w: np.ndarray, s: np.ndarray, tied: bool) -> np.ndarray:
    """Decoder pre-activation."""
    return h @ w[1:].T if tied else h @ s[1:] + s[0]


def target_of(x: np.ndarray, masked: np.ndarray, spec: LayerSpec) -> np.ndarray:
    t = masked if spec.rules.masked_target else x
    if spec.rules.shift_target and not spec.tied:
        t = np.concatenate([np.ones((len(t), 1)), t[:, :-1]], axis=1)
    return t


def masked_input(x: np.ndarray, keys: np.ndarray | None, spec: LayerSpec) -> np.ndarray:
    mask = spec.mask(keys, x.shape[1])
    return x if mask is None else x * mask


@dataclass
class Sums:
    """Sums over rows of everything an update step needs."""

    rows: float
    loss: float
    encoder: np.ndarray  # gradient of W
    decoder: np.ndarray  # gradient of S
    active: np.ndarray  # hidden activations
    lever: np.ndarray  # aT slope: effect of a constant added to a unit's error (else empty)

    @staticmethod
    def size(n: int, k: int, sparse: bool) -> int:
        return 2 + (2 if sparse else 1) * (n + 1) * k + (k + 1) * n + k

    def add_to(self, total: np.ndarray) -> None:
        """Add to a flat vector in place."""
        n, k = self.encoder.shape[0] - 1, self.encoder.shape[1]
        views = Sums.unflatten(total, n, k)
        total[0] += self.rows
        total[1] += self.loss
        for mine, theirs in (
            (self.encoder, views.encoder), (self.decoder, views.decoder),
            (self.active, views.active), (self.lever, views.lever),
        ):
            theirs += mine

    @staticmethod
    def unflatten(v: np.ndarray, n: int, k: int) -> Sums:
        cuts = np.cumsum([2, (n + 1) * k, (k + 1) * n, k])
        head, enc, dec, act, lever = np.split(v, cuts)
        return Sums(
            float(head[0]), float(head[1]), enc.reshape(n + 1, k), dec.reshape(k + 1, n),
            act, lever.reshape(-1, k),
        )


def sparsity(
    active: np.ndarray, rows: float, target: float, beta: float, power: int, guard: bool = False
):
    """(sum of KL terms, gradient constant per unit) from summed activations.

    With `guard` a dead or saturated unit's mean is kept off 0 and 1, as in `kl_term`.
    """
    p = active / rows
    if guard:
        p = np.clip(p, CLAMP, 1.0 - CLAMP)
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = target * np.log(target / p) + (1 - target) * np.log((1 - target) / (1 - p))
        pull = beta**power * ((1 - target) / (1 - p) - target / p)
    return float(kl.sum()), pull


def _with_bias_row(matrix: np.ndarray, bias: np.ndarray) -> np.ndarray:
    return np.concatenate([bias[None, :], matrix], axis=0)


def layer_sums(
    x: np.ndarray | SparseInput, keys: np.ndarray | None, w: np.ndarray, s: np.ndarray,
    spec: LayerSpec,
) -> Sums:
    """Loss and gradient sums of one block.

    The sparsity term adds one constant per unit, known only after the whole pass, to the
    hidden error. It factors out of the row sum, so the pass also returns `lever` and the
    caller adds `constant * lever`: the sparse method needs one pass over the data, not two.
    """
    if isinstance(x, SparseInput):
        a = sparse_masked(x, keys, spec)
        if a is not None:
            return sparse_layer_sums(x, a, w, s, spec)
        x = x.dense()
    a = masked_input(x, keys, spec)
    z = a @ w[1:] + w[0]
    h = activate(z, spec.activation)
    out = sigmoid(decode_input(h, w, s, spec.tied))
    t = target_of(x, a, spec)
    loss = cross_entropy(t, out, spec.rules.guard).sum()
    e = out - t
    slopes = slope(z, h, spec.activation)
    if spec.tied:
        hidden = (e @ w[1:]) * slopes
        decoder = np.zeros_like(s)
        weights = a.T @ hidden
        if not spec.rules.encoder_path:
            weights += e.T @ h
        encoder = _with_bias_row(weights, hidden.sum(axis=0))
    else:
        hidden = (e @ s[1:].T) * slopes
        decoder = _with_bias_row(h.T @ e, e.sum(axis=0))
        encoder = _with_bias_row(a.T @ hidden, hidden.sum(axis=0))
    if spec.method == "sparse":
        lever = _with_bias_row(a.T @ slopes, slopes.sum(axis=0))
    else:
        lever = np.zeros((0, w.shape[1]))
    return Sums(float(len(x)), float(loss), encoder, decoder, h.sum(axis=0), lever)


def layer_loss(
    x: np.ndarray, keys: np.ndarray | None, w: np.ndarray, s: np.ndarray, spec: LayerSpec
) -> tuple[float, np.ndarray]:
    """Loss of one block, and the activity of its units, without gradients."""
    a = masked_input(x, keys, spec)
    h = activate(a @ w[1:] + w[0], spec.activation)
    out = sigmoid(decode_input(h, w, s, spec.tied))
    loss = cross_entropy(target_of(x, a, spec), out, spec.rules.guard).sum()
    return float(loss), h.sum(axis=0)


def sparse_masked(
    x: SparseInput, keys: np.ndarray | None, spec: LayerSpec
) -> SparseInput | None:
    """A sparse block under the layer's mask; None where the block must be filled first.

    That is under rules without a guard, whose infinities come from zeros too, and where the mask
    makes too many columns dense.
    """
    if not spec.rules.guard:
        return None
    if spec.method != "denoising":
        return x
    at = np.flatnonzero(x.constant)
    if len(at) > SPARSE_SHARE * x.shape[1]:
        return None
    rows = mask_rows(keys, spec.layer, spec.epoch, spec.seed)
    return x.masked(
        mask_at(rows[x.part.rows], x.part.columns, spec.corruption),
        mask_at(rows[:, None], at[None, :], spec.corruption),
    )


def sparse_cross_entropy(x: SparseInput, p: np.ndarray) -> float:
    """Cross-entropy of all values of a block against sparse targets, summed.

    Where a target is 0 only the logarithm of 1 - p counts; the other one is taken for stored values and
    for columns with a constant part.
    """
    p = np.clip(p, CLAMP, 1.0 - CLAMP)
    off = np.log(1.0 - p)
    total = off.sum()
    at = np.flatnonzero(x.constant)
    if len(at):
        total += ((np.log(p[:, at]) - off[:, at]) @ x.constant[at]).sum()
    stored = x.part.rows, x.part.columns
    return -float(total + x.part.values @ (np.log(p[stored]) - off[stored]))


def sparse_layer_sums(
    x: SparseInput, a: SparseInput, w: np.ndarray, s: np.ndarray, spec: LayerSpec
) -> Sums:
    """The same sums for a sparse block x, masked as a.

    Products with the input take its stored values only. Outputs, and so products with errors, are dense.
    """
    z = a.times(w[1:]) + w[0]
    h = activate(z, spec.activation)
    out = sigmoid(decode_input(h, w, s, spec.tied))
    loss = sparse_cross_entropy(x, out)
    e = x.taken_from(out)
    slopes = slope(z, h, spec.activation)
    hidden = (e @ (w[1:] if spec.tied else s[1:].T)) * slopes
    wanted = [hidden, slopes] if spec.method == "sparse" else [hidden]
    # The transposed product gathers entries once for both.
    products = a.transposed_times(np.concatenate(wanted, axis=1))
    k = w.shape[1]
    weights = products[:, :k]
    if spec.tied:
        decoder = np.zeros_like(s)
        if not spec.rules.encoder_path:
            weights = weights + e.T @ h
    else:
        decoder = _with_bias_row(h.T @ e, e.sum(axis=0))
    lever = np.zeros((0, k))
    if spec.method == "sparse":
        lever = _with_bias_row(products[:, k:], slopes.sum(axis=0))
    encoder = _with_bias_row(weights, hidden.sum(axis=0))
    return Sums(float(len(x)), loss, encoder, decoder, h.sum(axis=0), lever)
