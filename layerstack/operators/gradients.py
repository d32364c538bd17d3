"""Aggregations over a finished or starting layer, as DataFrames.

Each is one pass over row blocks that emits one partial result per task, and one small reduction
keyed by hidden unit. The number of partials follows the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerstack.functions.activations import kl_gradient, kl_term
from layerstack.operators.blocks import (
    LayerSpec,
    activate,
    cross_entropy,
    decode_input,
    filled,
    layer_loss,
    layer_sums,
    masked_input,
    sigmoid,
    sparsity,
    target_of,
)
from layerstack.operators.sums import (
    PARTIAL_SCHEMA,
    REDUCE_BYTES,
    partial_row,
    sum_blocks,
    tree_totals,
)
from layerstack.operators.tables import Shared, Source


def mean_activation(source: Source, shared: Shared, upto: int, tasks: int) -> DataFrame:
    """`(unit, p, m)`: mean activation of every unit of layer `upto`, and the row count."""
    schema = "unit int, s double, m bigint"
    arrow = pa.schema([("unit", pa.int32()), ("s", pa.float64()), ("m", pa.int64())])
    read = source.read

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = shared.get()
        total, rows = None, 0
        for x, _ in read(batches):
            s = stack.encode(x, upto).sum(axis=0)
            total = s if total is None else total + s
            rows += len(x)
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(len(total), dtype="i4")),
                    pa.array(total),
                    pa.array(np.full(len(total), rows, dtype="i8")),
                ],
                schema=arrow,
            )

    return (
        source.narrowed(tasks)
        .mapInArrow(run, schema)
        .groupBy("unit")
        .agg((F.sum("s") / F.sum("m")).alias("p"), F.sum("m").alias("m"))
    )


def sparsity_terms(
    activity: DataFrame, target: float, beta: float, guard: bool = True
) -> DataFrame:
    """`(unit, p, kl, kl_gradient)` from a mean-activation table."""
    return activity.select(
        "unit",
        "p",
        kl_term("p", target, guard).alias("kl"),
        kl_gradient("p", target, beta, guard).alias("kl_gradient"),
    )


# One long-form row per weight. `i`, `j` are row and column (row 0 is the bias).
_ENTRY_SCHEMA = (
    "role string, i int, j int, w double, g double, lever double, active double, "
    "plus double, minus double, active_plus double, active_minus double, m double"
)
_ENTRY_ARROW = pa.schema(
    [("role", pa.string()), ("i", pa.int32()), ("j", pa.int32())]
    + [(c, pa.float64()) for c in (
        "w", "g", "lever", "active", "plus", "minus", "active_plus", "active_minus", "m")]
)
# Sums kept per encoder weight and per decoder weight, in the order of a unit's vector.
_ENCODER_SUMS = ("g", "lever", "plus", "minus", "active_plus", "active_minus")
_DECODER_SUMS = ("g", "plus", "minus")


def _entries(role: str, i: np.ndarray, j: np.ndarray, **columns) -> pa.RecordBatch:
    """Entry rows; columns left out are 0."""
    count = len(i)
    arrays = [pa.array([role] * count), pa.array(i.astype("i4")), pa.array(j.astype("i4"))]
    for name in _ENTRY_ARROW.names[3:]:
        values = np.broadcast_to(np.asarray(columns.get(name, 0.0), dtype="f8"), count)
        arrays.append(pa.array(np.ascontiguousarray(values)))
    return pa.RecordBatch.from_arrays(arrays, schema=_ENTRY_ARROW)


# Size of the outputs of a block that one step of the gradient check holds.
NUDGED_BYTES = 4 << 20


class _Nudged:
    """Loss and unit activity of a block with single weights moved up or down.

    All weights of one hidden unit, or of one output, are moved at once: column i of the result
    belongs to the weight in row i.
    """

    def __init__(self, x, keys, w, s, spec: LayerSpec):
        self.w, self.s, self.spec = w, s, spec
        self.a = masked_input(x, keys, spec)
        self.z = self.a @ w[1:] + w[0]
        self.h = activate(self.z, spec.activation)
        self.out = decode_input(self.h, w, s, spec.tied)
        self.t = target_of(x, self.a, spec)

    def _loss(self, t: np.ndarray, out: np.ndarray) -> np.ndarray:
        return cross_entropy(t, sigmoid(out), self.spec.rules.guard)

    def add_to(self, enc: np.ndarray, dec: np.ndarray, eps: float) -> None:
        """Add both nudges of every weight to the sums, laid out as the names above."""
        for side, by in ((0, eps), (1, -eps)):
            for j in range(self.w.shape[1]):
                loss, active = self.encoder(j, by)
                enc[2 + side, :, j] += loss
                enc[4 + side, :, j] += active
            if not self.spec.tied:
                for j in range(self.s.shape[1]):
                    dec[1 + side, :, j] += self.decoder(j, by)

    def encoder(self, j: int, by: float) -> tuple[np.ndarray, np.ndarray]:
        """Only unit j moves, so only its share of the outputs has to be redone."""
        h = activate(self.z[:, j : j + 1] + by * _with_ones(self.a), self.spec.activation)
        moved = h - self.h[:, j : j + 1]
        weights = self.w[1:, j] if self.spec.tied else self.s[j + 1]
        losses = np.empty(h.shape[1])
        step = max(1, NUDGED_BYTES // (8 * max(1, self.out.size)))
        for at in range(0, h.shape[1], step):
            end = min(at + step, h.shape[1])
            out = self.out[:, None, :] + moved[:, at:end, None] * weights
            if self.spec.tied:
                # A tied weight also leads from the unit to its own output.
                rows = np.arange(max(at, 1), end)
                out[:, rows - at, rows - 1] += by * h[:, rows]
            losses[at:end] = self._loss(self.t[:, None, :], out).sum(axis=(0, 2))
        return losses, h.sum(axis=0)

    def decoder(self, j: int, by: float) -> np.ndarray:
        """Only output j moves."""
        out = self.out[:, j : j + 1] + by * _with_ones(self.h)
        return self._loss(self.t[:, j : j + 1], out).sum(axis=0)


def _with_ones(x: np.ndarray) -> np.ndarray:
    """The inputs of a matrix, with that of its bias row first."""
    return np.concatenate([np.ones((len(x), 1)), x], axis=1)


def _entry_rows(
    source: Source, shared: Shared, layer: int, shape: tuple[int, int], eps: float | None,
    tasks: int,
) -> DataFrame:
    """Gradient sums (and, with eps, nudged losses) of one layer, one row per weight.

    A task emits one vector per hidden unit, with everything that belongs to the unit, and one
    for the decoder's bias. They are added up as vectors, in groups of bounded size, and only
    the totals are spread into rows.
    """
    read = source.read
    n, k = shape
    bytes_per_unit = 8 * (2 + len(_ENCODER_SUMS) * (n + 1) + len(_DECODER_SUMS) * n)
    fan = max(2, REDUCE_BYTES // bytes_per_unit)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = shared.get()
        w, s, spec = stack.weights[layer - 1], stack.decoders[layer - 1], stack.specs[layer - 1]
        enc = np.zeros((len(_ENCODER_SUMS) if eps else 2, *w.shape))
        dec = np.zeros((len(_DECODER_SUMS) if eps else 1, *s.shape))
        active, rows = np.zeros(k), 0
        for x, keys in read(batches):
            x = stack.encode(x, layer - 1)
            found = layer_sums(x, keys, w, s, spec)
            enc[0] += found.encoder
            dec[0] += found.decoder
            active += found.active
            if spec.method == "sparse":
                enc[1] += found.lever
            rows += len(x)
            if eps:
                _Nudged(filled(x), keys, w, s, spec).add_to(enc, dec, eps)
        if not rows:
            return
        part = TaskContext.get().partitionId()
        for unit in range(k):
            v = [[rows, active[unit]], enc[:, :, unit].ravel(), dec[:, unit + 1].ravel()]
            yield partial_row(unit, 0, part, np.concatenate(v))
        yield partial_row(k, 0, part, np.concatenate([[rows], dec[:, 0].ravel()]))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = shared.get()
        w, s, spec = stack.weights[layer - 1], stack.decoders[layer - 1], stack.specs[layer - 1]
        inputs, outputs = np.arange(n + 1), np.arange(n)
        for batch in batches:
            for unit, data in zip(batch.column(0).to_pylist(), batch.column(3)):
                v = np.frombuffer(data.as_buffer())
                rows, at = v[0], 1
                if unit < k:
                    at = 2 + (len(_ENCODER_SUMS) if eps else 2) * (n + 1)
                    found = dict(zip(_ENCODER_SUMS, v[2:at].reshape(-1, n + 1)))
                    yield _entries(
                        "encoder", inputs, np.full(n + 1, unit), w=w[:, unit], active=v[1],
                        m=rows, **found,
                    )
                if not spec.tied:
                    row = (unit + 1) % (k + 1)
                    found = dict(zip(_DECODER_SUMS, v[at:].reshape(-1, n)))
                    yield _entries("decoder", np.full(n, row), outputs, w=s[row], m=rows, **found)

    rows = source.narrowed(tasks)
    parts = min(tasks, max(1, rows.rdd.getNumPartitions()))
    totals = tree_totals(rows.mapInArrow(sums, PARTIAL_SCHEMA), parts, k + 1, fan)
    return totals.mapInArrow(spread, _ENTRY_SCHEMA)


def _penalty(spec: LayerSpec, target: float, beta: float) -> Column:
    """What the sparsity term adds to a summed encoder gradient."""
    if spec.method != "sparse":
        return F.lit(0.0)
    weight = beta**spec.rules.beta_power
    mean = F.col("active") / F.col("m")
    pull = kl_gradient(mean, target, weight, spec.rules.guard) * F.col("lever")
    return F.when(F.col("role") == "encoder", pull).otherwise(0.0)


def layer_gradients(
    source: Source, shared: Shared, layer: int, shape: tuple[int, int], spec: LayerSpec,
    target: float, beta: float, tasks: int,
) -> DataFrame:
    """`(role, i, j, g, m)`: gradient of a layer's matrices, summed over rows."""
    rows = _entry_rows(source, shared, layer, shape, None, tasks)
    return rows.select("role", "i", "j", (F.col("g") + _penalty(spec, target, beta)).alias("g"),
                       F.col("m").cast("bigint").alias("m"))


def checked_gradients(
    source: Source, shared: Shared, layer: int, shape: tuple[int, int], spec: LayerSpec,
    target: float, beta: float, lmbda: float, eps: float, tasks: int,
) -> DataFrame:
    """`(role, i, j, analytic, numeric, difference)` for every weight of a layer.

    Numeric values are central differences of the mean loss plus L2. All nudged losses come
    from the same single pass, so nothing is joined and the row count does not multiply. The
    textbook rules include the sparsity term on both sides; the reference rules leave it out
    of the numeric side.
    """
    bias = F.col("i") == 0
    l2 = F.when(bias, 0.0).otherwise(lmbda * F.col("w"))
    m = F.col("m")
    rows = _entry_rows(source, shared, layer, shape, eps, tasks)
    numeric = (F.col("plus") - F.col("minus")) / m / (2 * eps)
    if spec.method == "sparse" and spec.rules.beta_power == 1:
        up = kl_term(F.col("active_plus") / m, target, spec.rules.guard)
        down = kl_term(F.col("active_minus") / m, target, spec.rules.guard)
        numeric = numeric + F.when(
            F.col("role") == "encoder", beta * (up - down) / (2 * eps)
        ).otherwise(0.0)
    analytic = (F.col("g") + _penalty(spec, target, beta)) / m + l2
    return rows.select(
        "role", "i", "j", analytic.alias("analytic"), (numeric + l2).alias("numeric")
    ).withColumn("difference", F.abs(F.col("analytic") - F.col("numeric")))


def summarize_check(check: DataFrame) -> DataFrame:
    """`(role, analytic, numeric, difference, largest)`: sums over a gradient check's entries,
    and the largest difference of a single entry."""
    return check.groupBy("role").agg(
        F.sum("analytic").alias("analytic"),
        F.sum("numeric").alias("numeric"),
        (F.sum("numeric") - F.sum("analytic")).alias("difference"),
        F.max("difference").alias("largest"),
    )


def direction(shape: tuple[int, int], at: int, seed: int, tied: bool) -> tuple[np.ndarray, np.ndarray]:
    """A random direction of unit length in the space of a layer's weights: encoder and decoder parts."""
    n, k = shape
    source = np.random.default_rng([seed, at])
    w, s = source.normal(size=(n + 1, k)), source.normal(size=(k + 1, n))
    if tied:
        s[:] = 0.0
    length = np.sqrt((w**2).sum() + (s**2).sum())
    return w / length, s / length


def checked_directions(
    source: Source, stack, shared: Shared, layer: int, target: float, beta: float, lmbda: float,
    eps: float, directions: int, seed: int, tasks: int,
) -> DataFrame:
    """`(direction, analytic, numeric, difference)`: slopes of the cost along random directions.

    The analytic slope is the product of gradient and direction, the numeric one a central difference of the
    whole cost. One pass takes two more forward passes for each direction, whatever the number of
    weights, and a task emits a few numbers for each direction and unit, so whole tables can be checked.
    """
    spec, w, s = stack.specs[layer - 1], stack.weights[layer - 1], stack.decoders[layer - 1]
    shape = w.shape[0] - 1, w.shape[1]
    k = shape[1]
    each = 3 + 3 * k
    made: list[tuple[np.ndarray, np.ndarray]] = []

    def add(total: np.ndarray, x: np.ndarray, keys: np.ndarray | None) -> None:
        stack = shared.get()
        w, s, spec = stack.weights[layer - 1], stack.decoders[layer - 1], stack.specs[layer - 1]
        x = filled(stack.encode(x, layer - 1))
        found = layer_sums(x, keys, w, s, spec)
        total[0] += found.rows
        total[1 : 1 + k] += found.active
        for d in range(directions):
            if len(made) <= d:
                made.append(direction(shape, d, seed, spec.tied))
            by_w, by_s = made[d]
            own = total[1 + k + d * each :][:each]
            own[2] += (found.encoder * by_w).sum() + (found.decoder * by_s).sum()
            if spec.method == "sparse":
                own[3 + 2 * k :] += (found.lever * by_w).sum(axis=0)
            for side, step in ((0, eps), (1, -eps)):
                loss, active = layer_loss(x, keys, w + step * by_w, s + step * by_s, spec)
                own[side] += loss
                own[3 + side * k : 3 + (side + 1) * k] += active

    total = sum_blocks(source, 1 + k + directions * each, add, tasks)
    if total is None:
        raise ValueError("the table has no rows")
    rows, active = total[0], total[1 : 1 + k]
    power = spec.rules.beta_power
    out = []
    for d in range(directions):
        by_w, by_s = direction(shape, d, seed, spec.tied)
        own = total[1 + k + d * each :][:each]
        l2 = lambda w, s: lmbda / 2 * ((w[1:] ** 2).sum() + (s[1:] ** 2).sum())
        analytic = own[2] / rows + lmbda * ((w[1:] * by_w[1:]).sum() + (s[1:] * by_s[1:]).sum())
        numeric = (own[0] - own[1]) / rows / (2 * eps)
        numeric += (l2(w + eps * by_w, s + eps * by_s) - l2(w - eps * by_w, s - eps * by_s)) / (2 * eps)
        if spec.method == "sparse":
            _, pull = sparsity(active, rows, target, beta, power, spec.rules.guard)
            analytic += (pull * own[3 + 2 * k :]).sum() / rows
            ends = [
                sparsity(own[3 + i * k : 3 + (i + 1) * k], rows, target, beta, power, spec.rules.guard)[0]
                for i in (0, 1)
            ]
            numeric += beta * (ends[0] - ends[1]) / (2 * eps)
        out.append((d, float(analytic), float(numeric), float(abs(analytic - numeric))))
    schema = "direction int, analytic double, numeric double, difference double"
    return source.df.sparkSession.createDataFrame(out, schema)
