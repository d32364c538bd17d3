"""Passes over a table with a layer that is larger than a worker may hold.

The layer's units are cut into slices: a slice has some columns of the encoder and the same rows of the
decoder, and the decoder's bias row is a slice of its own (-1). Slices live in a table. Tasks get them as
one broadcast for each, through the driver one at a time, and hold as many as `budget` bytes allow; others
are read again from the executor's copy. For each block of rows a task goes through the slices twice:
forwards, adding up what each unit gives to the outputs, and backwards, with the errors. Gradient sums are
kept per slice, beyond the budget in a temporary file of the task, and added up slice by slice in a tree of shuffles.
So neither the driver nor a task holds the layer or its gradient, and no vector is as long as it.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerstack.operators.blocks import (
    LayerSpec,
    activate,
    cross_entropy,
    filled,
    masked_input,
    sigmoid,
    slope,
    sparse_cross_entropy,
    sparse_masked,
    sparsity,
)
from layerstack.operators.sparse import SparseInput
from layerstack.operators.sums import FAN, PARTIAL_SCHEMA, partial_row, tree_totals
from layerstack.operators.tables import Source

# Bytes of a slice (of the encoder and decoder weights of its units), if a unit is not larger.
SLICE_BYTES = 32 << 20
#: The slice of the decoder's bias row, and the partial with the number of rows and the loss.
BIAS, HEAD = -1, -2
SLICE_SCHEMA = "slice int, w binary, s binary, w_total binary, s_total binary"
_SLICE_ARROW = pa.schema(
    [("slice", pa.int32()), *((c, pa.binary()) for c in ("w", "s", "w_total", "s_total"))]
)


@dataclass(frozen=True)
class Cut:
    """How the k units of a layer with n inputs are cut into slices of `units` units."""

    n: int
    k: int
    units: int

    @staticmethod
    def of(n: int, k: int, slice_bytes: int = SLICE_BYTES) -> Cut:
        return Cut(n, k, max(1, min(k, slice_bytes // (8 * (2 * n + 1)))))

    @property
    def count(self) -> int:
        return -(-self.k // self.units)

    def span(self, j: int) -> tuple[int, int]:
        return j * self.units, min(self.k, (j + 1) * self.units)

    def shapes(self, j: int, spec: LayerSpec) -> list[tuple[int, ...]]:
        """What is summed for slice j: encoder, decoder, activity, lever."""
        if j == BIAS:
            return [(0, 0), (0 if spec.tied else 1, self.n), (0,), (0, 0)]
        low, high = self.span(j)
        b = high - low
        return [
            (self.n + 1, b), (0 if spec.tied else b, self.n), (b,),
            (self.n + 1 if spec.method == "sparse" else 0, b),
        ]

    def size(self, j: int, spec: LayerSpec) -> int:
        return sum(int(np.prod(shape)) for shape in self.shapes(j, spec))

    def views(self, v: np.ndarray, j: int, spec: LayerSpec) -> list[np.ndarray]:
        """The sums of slice j in a flat vector."""
        out, at = [], 0
        for shape in self.shapes(j, spec):
            size = int(np.prod(shape))
            out.append(v[at : at + size].reshape(shape))
            at += size
        return out


def initial_units(n: int, low: int, high: int, seed: int, layer: int) -> np.ndarray:
    """Start weights of some units, (n + 1) x units: a generator for each, so slices are made apart."""
    w = np.zeros((n + 1, high - low))
    for unit in range(low, high):
        w[1:, unit - low] = np.random.default_rng([seed, layer, unit]).normal(size=n)
    w[1:] *= np.sqrt(1.0 / n)
    return w


def slice_batch(j: int, *arrays: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([j], pa.int32()), *(pa.array([a.tobytes()], pa.binary()) for a in arrays)]
    return pa.RecordBatch.from_arrays(columns, schema=_SLICE_ARROW)


def start_slices(spark: SparkSession, cut: Cut, seed: int, layer: int) -> DataFrame:
    """Table of start weights: the encoder's, transposed for the decoder, and biases of 0."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in batch.column(0).to_pylist():
                if j == BIAS:
                    s = np.zeros((1, cut.n))
                    yield slice_batch(j, np.zeros(0), s, np.zeros(0), s)
                    continue
                w = initial_units(cut.n, *cut.span(j), seed, layer)
                s = np.ascontiguousarray(w[1:].T)
                yield slice_batch(j, w, s, np.zeros_like(w), np.zeros_like(s))

    numbers = spark.range(BIAS, cut.count, 1, max(1, min(cut.count, 4096)))
    return numbers.mapInArrow(make, SLICE_SCHEMA)


class Slices:
    """Broadcasts of a table's slices, made one after another."""

    def __init__(self, table: DataFrame, cut: Cut):
        self.cut = cut
        context = table.sparkSession.sparkContext
        self._held: dict[int, Broadcast] = {}
        for row in table.select("slice", "w", "s").toLocalIterator():
            w = np.frombuffer(row["w"])
            w = w.reshape((0, 0) if row["slice"] == BIAS else (cut.n + 1, -1))
            s = np.frombuffer(row["s"]).reshape(-1, cut.n)
            self._held[row["slice"]] = context.broadcast((w, s))
        if sorted(self._held) != list(range(BIAS, cut.count)):
            raise ValueError("the table of slices is not complete")

    def close(self) -> None:
        for held in self._held.values():
            held.destroy()

    def reader(self, budget: int) -> SliceReader:
        return SliceReader(self.cut, self._held, budget)


class SliceReader:
    """Slices in a task: kept within the budget, else read again each time."""

    def __init__(self, cut: Cut, held: dict[int, Broadcast], budget: int):
        self.cut, self._held, self._left = cut, held, budget
        self._kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def get(self, j: int) -> tuple[np.ndarray, np.ndarray]:
        if j in self._kept:
            return self._kept[j]
        value = self._held[j].value
        # The worker's copy would stay for good; the executor's file is still there.
        vars(self._held[j]).pop("_value", None)
        size = sum(a.nbytes for a in value)
        if size <= self._left:
            self._left -= size
            self._kept[j] = value
        return value

    def all(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for j in range(self.cut.count):
            yield j, *self.get(j)


class SliceSums:
    """Vectors of sums by slice: in memory within the budget, else in a temporary file."""

    def __init__(self, cut: Cut, spec: LayerSpec, budget: int):
        self.names = [BIAS, *range(cut.count)]
        sizes = [cut.size(j, spec) for j in self.names]
        total = sum(sizes)
        self._file = None
        if 8 * total <= budget or not total:
            whole = np.zeros(total)
        else:
            self._file = tempfile.TemporaryFile()
            self._file.truncate(8 * total)
            whole = np.memmap(self._file, "f8", "r+", shape=(total,))
        ends = np.cumsum(sizes).tolist()
        self.vectors = {j: whole[e - n : e] for j, e, n in zip(self.names, ends, sizes)}
        self.views = {j: cut.views(v, j, spec) for j, v in self.vectors.items()}

    def close(self) -> None:
        self.vectors, self.views = {}, {}
        if self._file is not None:
            self._file.close()


def times(x: np.ndarray | SparseInput, matrix: np.ndarray) -> np.ndarray:
    return x.times(matrix) if isinstance(x, SparseInput) else x @ matrix


def transposed_times(x: np.ndarray | SparseInput, matrix: np.ndarray) -> np.ndarray:
    return x.transposed_times(matrix) if isinstance(x, SparseInput) else x.T @ matrix


def _inputs(x: np.ndarray | SparseInput, keys: np.ndarray | None, spec: LayerSpec):
    """A block and the block under the layer's mask, both sparse or both filled."""
    if isinstance(x, SparseInput):
        a = sparse_masked(x, keys, spec)
        if a is not None:
            return x, a
        x = x.dense()
    return x, masked_input(x, keys, spec)


def _outputs(
    a: np.ndarray | SparseInput, reader: SliceReader, spec: LayerSpec
) -> tuple[np.ndarray, list[np.ndarray]]:
    """Outputs of a block, and the input of each slice's units."""
    out = np.zeros((len(a), reader.cut.n))
    if not spec.tied:
        out += reader.get(BIAS)[1][0]
    zs = []
    for _, w, s in reader.all():
        z = times(a, w[1:]) + w[0]
        h = activate(z, spec.activation)
        out += h @ (w[1:].T if spec.tied else s)
        zs.append(z)
    return sigmoid(out), zs


def _add_block(
    x: np.ndarray | SparseInput, keys: np.ndarray | None, reader: SliceReader, sums: SliceSums,
    spec: LayerSpec,
) -> float:
    """Add a block's sums, slice by slice; its loss."""
    x, a = _inputs(x, keys, spec)
    out, zs = _outputs(a, reader, spec)
    if isinstance(x, SparseInput):
        loss = sparse_cross_entropy(x, out)
        e = x.taken_from(out)
    else:
        loss = float(cross_entropy(x, out, spec.rules.guard).sum())
        e = out - x
    if not spec.tied:
        sums.views[BIAS][1][0] += e.sum(axis=0)
    for (j, w, s), z in zip(reader.all(), zs):
        h = activate(z, spec.activation)
        slopes = slope(z, h, spec.activation)
        hidden = (e @ (w[1:] if spec.tied else s.T)) * slopes
        encoder, decoder, active, lever = sums.views[j]
        encoder[0] += hidden.sum(axis=0)
        encoder[1:] += transposed_times(a, hidden)
        if spec.tied:
            encoder[1:] += e.T @ h
        else:
            decoder += h.T @ e
        active += h.sum(axis=0)
        if spec.method == "sparse":
            lever[0] += slopes.sum(axis=0)
            lever[1:] += transposed_times(a, slopes)
    return loss


def slice_totals(
    source: Source, slices: Slices, spec: LayerSpec, tasks: int, budget: int
) -> DataFrame:
    """`(chunk, bucket, part, v)`: the sums of each slice (chunk) over all rows; rows and loss as chunk HEAD."""
    if not spec.rules.guard:
        raise ValueError("layers in slices follow the standard semantics")
    read, reader_of = source.read, slices.reader
    cut = slices.cut

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, sums = reader_of(budget), None
        rows = loss = 0.0
        for x, keys in read(batches):
            if sums is None:
                sums = SliceSums(cut, spec, budget)
            loss += _add_block(x, keys, reader, sums, spec)
            rows += len(x)
        if sums is None:
            return
        part = TaskContext.get().partitionId()
        yield partial_row(HEAD, 0, part, np.array([rows, loss]))
        for j in sums.names:
            yield partial_row(j, 0, part, sums.vectors[j])
        sums.close()

    rows = source.narrowed(tasks)
    parts = max(1, min(tasks, rows.rdd.getNumPartitions()))
    return tree_totals(rows.mapInArrow(run, PARTIAL_SCHEMA), parts, cut.count + 2, FAN)


@dataclass(frozen=True)
class Step:
    """What a descent step needs besides the sums."""

    rows: float
    learning: float
    lmbda: float
    target: float
    beta: float


NEXT_SCHEMA = SLICE_SCHEMA + ", w_step binary, s_step binary, w_square double, s_square double, kl double"
_NEXT_ARROW = pa.schema([
    *_SLICE_ARROW, ("w_step", pa.binary()), ("s_step", pa.binary()), ("w_square", pa.float64()),
    ("s_square", pa.float64()), ("kl", pa.float64()),
])


def averaged_slices(
    table: DataFrame, totals: DataFrame, cut: Cut, spec: LayerSpec, step: Step
) -> DataFrame:
    """Slices with their averaged gradients (steps) and the running sums of these, each slice by itself.

    Squares of the running sums, and the sparsity terms, are numbers of each slice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                j = batch.column(0)[i].as_py()
                w, s, w_total, s_total, v = (
                    np.frombuffer(batch.column(c)[i].as_buffer()) for c in range(1, 6)
                )
                encoder, decoder, active, lever = cut.views(v, j, spec)
                kl = 0.0
                gradient = encoder / step.rows
                if j != BIAS and spec.method == "sparse":
                    kl, pull = sparsity(active, step.rows, step.target, step.beta, 1, guard=True)
                    gradient += lever * pull / step.rows
                if j != BIAS:
                    gradient[1:] += step.lmbda * w.reshape(gradient.shape)[1:]
                s_gradient = (decoder / step.rows).ravel()
                if spec.tied:
                    s_gradient = np.zeros_like(s)
                elif j != BIAS:
                    s_gradient += step.lmbda * s
                w_total, s_total = w_total + gradient.ravel(), s_total + s_gradient
                arrays = [w, s, w_total, s_total, gradient.ravel(), s_gradient]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([j], pa.int32()),
                        *(pa.array([a.tobytes()], pa.binary()) for a in arrays),
                        *(pa.array([float(x)]) for x in (w_total @ w_total, s_total @ s_total, kl)),
                    ],
                    schema=_NEXT_ARROW,
                )

    sums = totals.select(F.col("chunk").alias("slice"), F.col("v"))
    joined = table.join(sums, "slice").select("slice", "w", "s", "w_total", "s_total", "v")
    return joined.mapInArrow(run, NEXT_SCHEMA)


def stepped_slices(averaged: DataFrame, w_rate: float, s_rate: float, cut: Cut, tied: bool) -> DataFrame:
    """Slices after the step; a tied decoder follows its encoder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                j = batch.column(0)[i].as_py()
                w, s, w_total, s_total, w_step, s_step = (
                    np.frombuffer(batch.column(c)[i].as_buffer()) for c in range(1, 7)
                )
                w, s = w - w_rate * w_step, s - s_rate * s_step
                if tied and j != BIAS:
                    s = np.ascontiguousarray(w.reshape(cut.n + 1, -1)[1:].T)
                if not (np.isfinite(w).all() and np.isfinite(s).all()):
                    raise ArithmeticError("weights are no longer finite: lower the learning rate or beta")
                yield slice_batch(j, w, s, w_total, s_total)

    return averaged.drop("w_square", "s_square", "kl").mapInArrow(run, SLICE_SCHEMA)


def long_weights(table: DataFrame, cut: Cut, layer: int) -> DataFrame:
    """`(layer, role, row, col, w)` of a table of slices, as of a model table."""
    doubles = "array<double>"

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(0)]
            for c in (1, 2):
                values = [np.frombuffer(v.as_buffer()) for v in batch.column(c)]
                ends = pa.array(np.cumsum([0, *map(len, values)]), pa.int32())
                columns.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(values))))
            yield pa.RecordBatch.from_arrays(columns, names=["slice", "w", "s"])

    held = table.select("slice", "w", "s").mapInArrow(numbers, f"slice int, w {doubles}, s {doubles}")
    first = F.col("slice") * cut.units
    width = F.least(F.lit(cut.units), F.lit(cut.k) - first)
    encoder = held.where(F.col("slice") != BIAS).select(
        "slice", width.alias("b"), F.posexplode("w").alias("at", "w")
    ).select(
        F.lit("encoder").alias("role"), F.floor(F.col("at") / F.col("b")).cast("int").alias("row"),
        (first + F.col("at") % F.col("b")).cast("int").alias("col"), "w",
    )
    row = F.when(F.col("slice") == BIAS, 0).otherwise(first + 1 + F.floor(F.col("at") / cut.n))
    decoder = held.select("slice", F.posexplode("s").alias("at", "w")).select(
        F.lit("decoder").alias("role"), row.cast("int").alias("row"),
        (F.col("at") % cut.n).cast("int").alias("col"), "w",
    )
    return encoder.union(decoder).select(F.lit(layer).alias("layer"), "role", "row", "col", "w")


def sliced_codes(
    x: np.ndarray | SparseInput, reader: SliceReader, spec: LayerSpec
) -> np.ndarray:
    """Codes of a block; no mask outside training."""
    codes = [activate(times(x, w[1:]) + w[0], spec.activation) for _, w, _ in reader.all()]
    return np.concatenate(codes, axis=1)


def sliced_losses(x: np.ndarray | SparseInput, reader: SliceReader, spec: LayerSpec) -> np.ndarray:
    """Cross-entropy of each row, without a mask."""
    out, _ = _outputs(x, reader, replace(spec, method="regular"))
    return cross_entropy(filled(x), out, spec.rules.guard).sum(axis=1)
