"""Feature width, ranges and validity of a table, in one pass.

A task's figures are vectors, cut into chunks of features, and combined in a tree of shuffles: a row of
a shuffle stands for thousands of features, and none is as long as the table is wide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from layerstack.operators.sparse import vector_rows
from layerstack.operators.sums import FAN, PARTIAL_SCHEMA, partial_row, tree_totals
from layerstack.operators.tables import list_parts, stored_column, task_bound

_SCHEMA = "feature int, lo double, hi double, n bigint, bad bigint"
_ARROW = pa.schema(
    [("feature", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()),
     ("n", pa.int64()), ("bad", pa.int64())]
)
# Features whose figures travel together: a megabyte.
CHUNK_FEATURES = 1 << 15
# The chunk with counts of rows: rows, null vectors, rows of the fullest task.
HEAD = -1


class _Running:
    """Per-feature minimum, maximum and counts, growing with the widest row seen."""

    def __init__(self) -> None:
        self.lo = np.zeros(0)
        self.hi = np.zeros(0)
        self.n = np.zeros(0, "i8")
        self.bad = np.zeros(0, "i8")
        self.rows = 0
        self.null_rows = 0

    def _grow(self, width: int) -> None:
        more = width - len(self.lo)
        if more > 0:
            self.lo = np.concatenate([self.lo, np.full(more, np.nan)])
            self.hi = np.concatenate([self.hi, np.full(more, np.nan)])
            self.n = np.concatenate([self.n, np.zeros(more, "i8")])
            self.bad = np.concatenate([self.bad, np.zeros(more, "i8")])

    def add(self, column: pa.Array) -> None:
        self.rows += len(column)
        self.null_rows += column.null_count
        if column.null_count:
            column = column.drop_null()
        if not len(column):
            return
        sizes = np.diff(column.offsets.to_numpy())
        values = column.flatten().to_numpy(zero_copy_only=False).astype("f8", copy=False)
        width = int(sizes.max())
        self._grow(width)
        if (sizes == width).all():
            x = values.reshape(len(sizes), width)
        else:  # ragged: NaN-pad here; the counts below tell the widths apart
            x = np.full((len(sizes), width), np.nan)
            x[np.arange(width)[None, :] < sizes[:, None]] = values
        present = (np.arange(width)[None, :] < sizes[:, None]).sum(axis=0)
        good = ~np.isnan(x)
        self.n[:width] += present
        self.bad[:width] += present - good.sum(axis=0)
        self._widen(np.fmin.reduce(x, axis=0), np.fmax.reduce(x, axis=0))

    def add_block(self, rows: int, null_rows: int, bad: int, lo: bytes, hi: bytes) -> None:
        """Take in what `pack` stored with a block; its defects are booked on feature 0."""
        self.rows += rows + null_rows
        self.null_rows += null_rows
        width = len(lo) // 8 if lo else 0
        if not width:
            return
        self._grow(width)
        self.n[:width] += rows
        self.bad[0] += bad
        self._widen(np.frombuffer(lo), np.frombuffer(hi))

    def _widen(self, lo: np.ndarray, hi: np.ndarray) -> None:
        """Extend the ranges; NaN stands for no value yet."""
        width = len(lo)
        self.lo[:width] = np.fmin(self.lo[:width], lo)
        self.hi[:width] = np.fmax(self.hi[:width], hi)

    def add_vectors(self, column: pa.StructArray) -> None:
        """Take in ML vectors by their stored values; features that some rows leave out reach 0."""
        self.rows += len(column)
        self.null_rows += column.null_count
        column = column.drop_null()
        if not len(column):
            return
        size, values = column.field("size"), column.field("values")
        widths = pc.if_else(pc.is_null(size), pc.list_value_length(values), size).to_numpy()
        for width in np.unique(widths).tolist():
            rows = vector_rows(column.filter(pa.array(widths == width)), width)
            self._grow(width)
            self.n[:width] += len(rows)
            held = np.bincount(rows.columns, minlength=width)
            lo = np.where(held < len(rows), 0.0, np.nan)
            hi = lo.copy()
            order = rows.by_column
            columns, stored = rows.columns[order], rows.values[order]
            self.bad[:width] += np.bincount(columns[np.isnan(stored)], minlength=width)
            if len(columns):
                first = np.flatnonzero(np.diff(columns, prepend=-1))
                at = columns[first]
                lo[at] = np.fmin(lo[at], np.fmin.reduceat(stored, first))
                hi[at] = np.fmax(hi[at], np.fmax.reduceat(stored, first))
            self._widen(lo, hi)

    def partials(self, part: int) -> Iterator[pa.RecordBatch]:
        head = np.array([self.rows, self.null_rows, self.rows], "f8")
        yield partial_row(HEAD, 0, part, head)
        for chunk, at in enumerate(range(0, len(self.lo), CHUNK_FEATURES)):
            some = np.s_[at : at + CHUNK_FEATURES]
            figures = [self.lo[some], self.hi[some], self.n[some], self.bad[some]]
            yield partial_row(chunk, 0, part, np.concatenate(figures).astype("f8"))


def _combined(chunk: int, total: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Figures of two sets of rows; the narrower set has nothing for the features it lacks."""
    if chunk == HEAD:
        return np.array([total[0] + v[0], total[1] + v[1], max(total[2], v[2])])
    a, b = total.reshape(4, -1), v.reshape(4, -1)
    width = max(a.shape[1], b.shape[1])
    out = np.zeros((4, width))
    out[:2] = np.nan
    out[:, : a.shape[1]] = a
    some = out[:, : b.shape[1]]
    some[0], some[1] = np.fmin(some[0], b[0]), np.fmax(some[1], b[1])
    some[2:] += b[2:]
    return out.ravel()


def _totals(parts: DataFrame, tasks: int) -> DataFrame:
    """One row of figures for each chunk of features, and the head."""
    found = parts.rdd.getNumPartitions()
    return tree_totals(parts, max(1, min(tasks, found)), 8, FAN, _combined)


def _figure_totals(df: DataFrame, features: str | list[str], max_tasks: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running = _Running()
        for batch in batches:
            column = batch.column(0)
            if pa.types.is_struct(column.type):
                running.add_vectors(column)
                continue
            for lists in list_parts(column):
                running.add(lists)
        if running.rows:
            yield from running.partials(TaskContext.get().partitionId())

    tasks = task_bound(df.sparkSession, max_tasks)
    column = stored_column(df, features).alias("x")
    return _totals(df.select(column).coalesce(tasks).mapInArrow(run, PARTIAL_SCHEMA), tasks)


def feature_profile(df: DataFrame, features: str | list[str], max_tasks: int = 0) -> DataFrame:
    """`(feature, lo, hi, n, bad)`: range, count and number of null or NaN values per feature.

    The row with feature -1 counts table rows in `n` and null vectors in `bad`. One pass over
    the feature column, and a tree that combines the tasks' figures.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(3)):
                v = np.frombuffer(data.as_buffer())
                if chunk == HEAD:
                    features, lo, hi, n, bad = np.array([-1]), *np.full((2, 1), np.nan), v[:1], v[1:2]
                else:
                    lo, hi, n, bad = v.reshape(4, -1)
                    features = chunk * CHUNK_FEATURES + np.arange(len(lo))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(features, pa.int32()),
                        *(pa.array(x, pa.float64(), mask=np.isnan(x)) for x in (lo, hi)),
                        *(pa.array(x.astype("i8")) for x in (n, bad)),
                    ],
                    schema=_ARROW,
                )

    return _figure_totals(df, features, max_tasks).mapInArrow(spread, _SCHEMA)


@dataclass
class Profile:
    rows: int
    width: int
    lo: np.ndarray
    hi: np.ndarray
    heaviest: int  # rows of the fullest task of the pass


def checked_profile(
    df: DataFrame, features: str | list[str], width: int = 0, max_tasks: int = 0
) -> Profile:
    """Profile of a table that can be trained on; raises for any row that cannot."""
    return _checked(_figure_totals(df, features, max_tasks), width)


def block_profile(blocks: DataFrame, width: int = 0, max_tasks: int = 0) -> Profile:
    """The same for a packed block table. It reads the figures stored with the blocks, not the
    values: about a thousandth of the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running = _Running()
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                running.add_block(*row)
        if running.rows:
            yield from running.partials(TaskContext.get().partitionId())

    tasks = task_bound(blocks.sparkSession, max_tasks)
    figures = blocks.select("rows", "null_rows", "bad", "lo", "hi").coalesce(tasks)
    return _checked(_totals(figures.mapInArrow(run, PARTIAL_SCHEMA), tasks), width)


def _checked(totals: DataFrame, width: int) -> Profile:
    """The figures of all chunks (four numbers for each feature, as the model's ranges need them)."""
    found = {r.chunk: np.frombuffer(r.v) for r in totals.select("chunk", "v").collect()}
    if HEAD not in found:
        raise ValueError("the input has no rows")
    rows, null_rows, heaviest = map(int, found.pop(HEAD))
    if null_rows:
        raise ValueError(f"{null_rows} of {rows} feature vectors are null")
    if not found:
        raise ValueError("feature vectors are empty")
    chunks = [found[c].reshape(4, -1) for c in sorted(found)]
    lo, hi, n, bad = np.concatenate(chunks, axis=1)
    if (n != rows).any():
        raise ValueError(f"feature vectors differ in width (widest: {len(n)})")
    if width and width != len(n):
        raise ValueError(f"features have width {len(n)}, not {width}")
    if bad.any():
        raise ValueError(f"{int(bad.sum())} feature values are null or NaN")
    if not (np.isfinite(lo).all() and np.isfinite(hi).all()):
        raise ValueError("feature values are infinite")
    return Profile(rows, len(n), lo, hi, heaviest)


def check_unit_range(profile: Profile) -> None:
    """The loss is a cross-entropy, so unscaled features must lie in [0, 1]."""
    if (profile.lo < 0).any() or (profile.hi > 1).any():
        raise ValueError("features lie outside [0, 1]; scale them or leave scaling on")
