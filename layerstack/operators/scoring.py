"""Row-wise work of a finished stack: codes, reconstructions and losses.

These are scalar Arrow UDFs over one column, not table functions: Catalyst still prunes unused
columns and pushes filters on other columns below them into the scan, and they accept
streaming tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from layerstack.operators.blocks import (
    LayerSpec,
    bounded,
    cross_entropy,
    decode_input,
    encode_layer,
    features_block,
    filled,
    scale_block,
    sigmoid,
    target_of,
)
from layerstack.operators.randoms import fixed_mask
from layerstack.operators.sparse import SparseInput, sparse_inputs
from layerstack.operators.tables import Shared, block_rows
from layerstack.operators.vectors import skip_nulls, vector_udf


@dataclass
class Stack:
    """Finished layers: weights, decoders, the pass settings, the scaling and the rule for values
    outside its ranges."""

    weights: list[np.ndarray]
    decoders: list[np.ndarray]
    specs: list[LayerSpec]
    ranges: tuple[np.ndarray, np.ndarray] | None
    outside: str = "keep"

    def add(self, w: np.ndarray, s: np.ndarray, spec: LayerSpec) -> None:
        self.weights.append(w)
        self.decoders.append(s)
        self.specs.append(spec)

    @property
    def width(self) -> int:
        return self.weights[0].shape[0] - 1

    def arrays(self) -> list[np.ndarray]:
        return [*self.weights, *self.decoders, *(self.ranges or ())]

    def blocks(self, column: pa.Array) -> Iterator[np.ndarray | SparseInput]:
        """Scaled rows of a feature column: lists at once, ML vectors in blocks as sparse as they are."""
        if not pa.types.is_struct(column.type):
            x = scale_block(features_block(column, self.width), self.ranges)
            yield bounded(x, self.outside)
            return
        if not len(column):
            yield np.zeros((0, self.width))
        for x in sparse_inputs(column, self.width, self.ranges, block_rows(self.width)):
            yield x if self.outside == "keep" else bounded(filled(x), self.outside)

    def codes(self, column: pa.Array, upto: int) -> np.ndarray:
        return np.concatenate([self.encode(x, upto) for x in self.blocks(column)])

    def encode(self, x: np.ndarray | SparseInput, upto: int) -> np.ndarray | SparseInput:
        for w, spec in zip(self.weights[:upto], self.specs[:upto]):
            x = encode_layer(x, w, spec)
        return x

    def decode_once(self, h: np.ndarray, layer: int) -> np.ndarray:
        at = layer - 1
        return sigmoid(
            decode_input(h, self.weights[at], self.decoders[at], self.specs[at].tied)
        )


def encode_column(shared: Shared, x: Column, upto: int) -> Column:
    def make(c: pa.Array) -> np.ndarray:
        return shared.get().codes(c, upto)

    return vector_udf(make, x)


def reconstruct_column(
    shared: Shared, x: Column, upto: int, down_to: int, original_units: bool
) -> Column:
    """Decode the codes of layer `upto` back to the inputs of layer `down_to + 1`."""

    def make(c: pa.Array) -> np.ndarray:
        stack = shared.get()
        y = stack.codes(c, upto)
        for layer in range(upto, down_to, -1):
            y = stack.decode_once(y, layer)
        if original_units and stack.ranges is not None:
            lo, hi = stack.ranges
            y = lo + y * (hi - lo)
        return y

    return vector_udf(make, x)


def loss_column(shared: Shared, x: Column, upto: int) -> Column:
    """Cross-entropy of layer `upto` for every row, as summed in its training loss."""

    @F.arrow_udf("double")
    def run(v: pa.Array) -> pa.Array:
        def loss_of(stack: Stack, x: np.ndarray | SparseInput) -> np.ndarray:
            spec = stack.specs[upto - 1]
            inputs = stack.encode(x, upto - 1)
            codes = encode_layer(inputs, stack.weights[upto - 1], spec)
            out = stack.decode_once(codes, upto)
            inputs = filled(inputs)
            masked = inputs
            if spec.method == "denoising" and spec.rules.fixed_mask:
                masked = inputs * fixed_mask(inputs.shape[1])
            target = target_of(inputs, masked, spec)
            return cross_entropy(target, out, spec.rules.guard).sum(axis=1)

        def loss(c: pa.Array) -> pa.Array:
            stack = shared.get()
            return pa.array(np.concatenate([loss_of(stack, x) for x in stack.blocks(c)]))

        return skip_nulls(v, loss)

    return run(x)
