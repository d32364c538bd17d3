"""Products of sparse rows by their stored values, with scaling folded into the weights.

A row scaled to (x - lo) / span is the sum of a sparse row x / span and a constant row -lo / span. The
sparse part takes part in a product by its stored values only, and the constant row by one product for
the whole block, so no scaled row is ever written out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Numbers that one step of a sparse product gathers: 8 MB.
GATHERED_CELLS = 1 << 20
# Blocks with a larger share of stored values (or of columns that a mask makes dense) are filled with
# zeros: a dense product is faster there (measured: 256 rows, 2,000 and 10,000 columns).
SPARSE_SHARE = 0.06


@dataclass(frozen=True)
class SparseRows:
    """Compressed rows: row i holds the entries starts[i] to starts[i + 1]."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    def __len__(self) -> int:
        return len(self.starts) - 1

    @cached_property
    def rows(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(len(self)), np.diff(self.starts))

    @cached_property
    def by_column(self) -> np.ndarray:
        """Entries in order of their columns."""
        return np.argsort(self.columns, kind="stable")

    @property
    def share(self) -> float:
        return len(self.values) / max(1, len(self) * self.width)

    def with_values(self, values: np.ndarray) -> SparseRows:
        return SparseRows(self.starts, self.columns, values, self.width)

    def slice(self, at: int, count: int) -> SparseRows:
        starts = self.starts[at : at + count + 1]
        part = np.s_[starts[0] : starts[-1]]
        return SparseRows(starts - starts[0], self.columns[part], self.values[part], self.width)

    def dense(self) -> np.ndarray:
        out = np.zeros((len(self), self.width))
        out[self.rows, self.columns] = self.values
        return out

    def _pieces(self, k: int) -> Iterator[tuple[int, int, int]]:
        """Row by row, the entries that may be gathered at once with k numbers for each."""
        step = max(1, GATHERED_CELLS // max(1, k))
        bounds = self.starts.tolist()
        for row, (begin, end) in enumerate(zip(bounds, bounds[1:])):
            for at in range(begin, end, step):
                yield row, at, min(at + step, end)

    def times(self, matrix: np.ndarray) -> np.ndarray:
        """(rows, k): this block times a (width, k) matrix."""
        out = np.zeros((len(self), matrix.shape[1]))
        for row, a, b in self._pieces(matrix.shape[1]):
            out[row] += self.values[a:b] @ matrix[self.columns[a:b]]
        return out

    def transposed_times(self, matrix: np.ndarray) -> np.ndarray:
        """(width, k): this block's transpose times a (rows, k) matrix."""
        out = np.zeros((self.width, matrix.shape[1]))
        for row, a, b in self._pieces(matrix.shape[1]):
            # A row has each column once, so nothing is added twice.
            out[self.columns[a:b]] += np.multiply.outer(self.values[a:b], matrix[row])
        return out


@dataclass(frozen=True)
class SparseInput:
    """Input rows of a layer: a sparse part, a constant row, and some columns that a mask made dense."""

    part: SparseRows
    constant: np.ndarray
    dense_columns: np.ndarray
    dense_values: np.ndarray

    @staticmethod
    def scaled(rows: SparseRows, ranges: tuple[np.ndarray, np.ndarray] | None) -> SparseInput:
        """Rows scaled by (lo, hi) ranges; a constant feature becomes 0."""
        width = rows.width
        empty = np.empty(0, "i8"), np.empty((len(rows), 0))
        if ranges is None:
            return SparseInput(rows, np.zeros(width), *empty)
        lo, hi = ranges
        span = hi - lo
        per = np.divide(1.0, span, out=np.zeros(width), where=span != 0)
        part = rows.with_values(rows.values * per[rows.columns])
        return SparseInput(part, -lo * per, *empty)

    def __len__(self) -> int:
        return len(self.part)

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.part), self.part.width

    def dense(self) -> np.ndarray:
        out = self.part.dense() + self.constant
        out[:, self.dense_columns] += self.dense_values
        return out

    def masked(self, keep_entries: np.ndarray, keep_columns: np.ndarray) -> SparseInput:
        """Under a mask, given for each entry and for each column whose constant is not 0."""
        at = np.flatnonzero(self.constant)
        return SparseInput(
            self.part.with_values(self.part.values * keep_entries), np.zeros_like(self.constant), at,
            keep_columns * self.constant[at],
        )

    def times(self, matrix: np.ndarray) -> np.ndarray:
        out = self.part.times(matrix)
        if self.constant.any():
            out += self.constant @ matrix
        if len(self.dense_columns):
            out += self.dense_values @ matrix[self.dense_columns]
        return out

    def transposed_times(self, matrix: np.ndarray) -> np.ndarray:
        out = self.part.transposed_times(matrix)
        if self.constant.any():
            out += np.outer(self.constant, matrix.sum(axis=0))
        if len(self.dense_columns):
            out[self.dense_columns] += self.dense_values.T @ matrix
        return out

    def taken_from(self, matrix: np.ndarray) -> np.ndarray:
        """A (rows, width) matrix less these rows, in place; no masks here."""
        if self.constant.any():
            matrix -= self.constant
        matrix[self.part.rows, self.part.columns] -= self.part.values
        return matrix


def vector_rows(column: pa.StructArray, width: int) -> SparseRows:
    """A column of ML vectors, none of them null, as compressed rows. Stored zeros stay entries."""
    kind, size, indices, values = column.flatten()
    if column.null_count:
        raise ValueError("features hold nulls")
    held = pc.list_value_length(values).to_numpy()
    sparse = kind.to_numpy() == 0
    sizes = np.where(sparse, size.fill_null(0).to_numpy(), held)
    if len(sizes) and (sizes != width).any():
        raise ValueError(f"every row must have {width} features, found {set(sizes.tolist())}")
    starts = np.concatenate([[0], np.cumsum(held)])
    columns = np.arange(starts[-1]) - np.repeat(starts[:-1], held)
    columns[np.repeat(sparse, held)] = indices.filter(pa.array(sparse)).flatten().to_numpy()
    return SparseRows(starts, columns, values.flatten().to_numpy(), width)


def sparse_inputs(
    column: pa.StructArray, width: int, ranges: tuple[np.ndarray, np.ndarray] | None, step: int
) -> Iterator[SparseInput | np.ndarray]:
    """Blocks of `step` scaled rows; those that are not sparse are filled with zeros."""
    rows = vector_rows(column, width)
    for at in range(0, len(rows), step):
        block = SparseInput.scaled(rows.slice(at, step), ranges)
        yield block if block.part.share <= SPARSE_SHARE else block.dense()
