"""Layers in slices against the same layers held whole."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from layerstack.operators import slices as sl
from layerstack.operators.blocks import LayerSpec
from layerstack.operators.rules import Rules
from layerstack.plans import training
from layerstack.plans.blocked import fit_blocked
from layerstack.plans.training import Settings, train

OPTIONS = dict(features="embedding", ids=["vec_id"], epochs=3, beta=0.05, lmbda=1e-3)


@pytest.fixture
def same_starts(monkeypatch):
    monkeypatch.setattr(
        training, "initial_encoder", lambda n, k, rules, seed, layer: sl.initial_units(n, 0, k, seed, layer)
    )


def whole(long, layer, role):
    rows = long.where((F.col("layer") == layer) & (F.col("role") == role)).collect()
    out = np.full((1 + max(r.row for r in rows), 1 + max(r.col for r in rows)), np.nan)
    for r in rows:
        out[r.row, r.col] = r.w
    assert len(rows) == out.size and not np.isnan(out).any()
    return out


@pytest.mark.parametrize("units", [1, 3, 100])
@pytest.mark.parametrize("method", ["regular", "denoising", "sparse"])
def test_as_whole_layers(embeddings, same_starts, method, units):
    df = embeddings.repartition(5)
    stack = fit_blocked(
        df, slice_bytes=units * 8 * 129, hidden=[7, 3], method=method, model_bytes=4000, **OPTIONS
    )
    assert stack.layers[0].cut.count == -(-7 // min(units, 7))
    want, reports = train(df, Settings(hidden=[7, 3], method=method, **OPTIONS))
    np.testing.assert_allclose(
        [r.loss for r in stack.history.orderBy("layer", "epoch").collect()], [r.loss for r in reports]
    )
    long = stack.weights_long()
    for layer in (1, 2):
        np.testing.assert_allclose(whole(long, layer, "encoder"), want.weights[layer - 1], atol=1e-9)
        np.testing.assert_allclose(whole(long, layer, "decoder"), want.decoders[layer - 1], atol=1e-9)
    stack.close()


@pytest.mark.parametrize("activation", ["tanh", "relu"])
def test_tied_and_activations(embeddings, same_starts, activation):
    options = dict(OPTIONS, hidden=[5], method="sparse" if activation == "sigmoid" else "regular")
    options |= dict(tied=True, activation=activation, learning=0.02)
    stack = fit_blocked(embeddings, slice_bytes=2500, **options)
    want, reports = train(embeddings, Settings(**options))
    np.testing.assert_allclose([r.loss for r in stack.history.collect()], [r.loss for r in reports])
    np.testing.assert_allclose(whole(stack.weights_long(), 1, "encoder"), want.weights[0], atol=1e-9)


def test_codes_and_losses(embeddings, same_starts):
    options = dict(OPTIONS, hidden=[6, 4], method="denoising")
    stack = fit_blocked(embeddings, slice_bytes=2500, **options)
    want, _ = train(embeddings, Settings(**options))
    x = np.array([r.embedding for r in embeddings.orderBy("vec_id").collect()], "f8")
    lo, hi = want.ranges
    x = (x - lo) / (hi - lo)
    for upto in (1, 2):
        got = stack.encode(embeddings, ["vec_id"], upto).orderBy("vec_id").collect()
        np.testing.assert_allclose([r.code for r in got], want.encode(x, upto), atol=1e-9)
    loss = stack.score(embeddings, ["vec_id"]).orderBy("vec_id").collect()
    h = want.encode(x, 1)
    out = want.decode_once(want.encode(x, 2), 2)
    np.testing.assert_allclose(
        [r.loss for r in loss], -(h * np.log(out) + (1 - h) * np.log(1 - out)).sum(axis=1), atol=1e-9
    )


def test_sparse_vectors(embeddings, same_starts):
    thin = embeddings.select(
        "vec_id", F.transform("embedding", lambda v: F.when(v > 0.25, v.cast("double")).otherwise(0.0)).alias("x")
    )
    options = dict(OPTIONS, hidden=[5], method="sparse", ids=[])
    vectors = thin.withColumn("x", array_to_vector("x"))
    a = fit_blocked(vectors, slice_bytes=2500, **dict(options, features="x"))
    b, reports = train(thin, Settings(**dict(options, features="x")))
    np.testing.assert_allclose([r.loss for r in a.history.collect()], [r.loss for r in reports])


def test_memory_is_bounded():
    """Sums beyond the budget live in a file, slices beyond it are read again."""
    cut, spec = sl.Cut.of(10, 7, 8 * 21 * 2), LayerSpec("sparse", Rules.of("standard"))
    assert cut.units == 2 and cut.count == 4 and cut.span(3) == (6, 7)
    small, large = sl.SliceSums(cut, spec, 100), sl.SliceSums(cut, spec, 1 << 20)
    assert isinstance(small.vectors[0], np.memmap) and not isinstance(large.vectors[0], np.memmap)
    for sums in (small, large):
        sums.views[2][2][:] += 3.0
        assert sums.vectors[2].sum() == 6.0 and sum(v.sum() for v in sums.vectors.values()) == 6.0
        sums.close()

    class Held:
        reads = 0

        @property
        def value(self):
            Held.reads += 1
            return np.zeros((11, 2)), np.zeros((2, 10))

    reader = sl.SliceReader(cut, {j: Held() for j in range(4)}, 2 * 8 * 42)
    for _ in range(3):
        list(reader.all())
    assert Held.reads == 4 + 2 + 2


def test_refusals(spark, embeddings):
    with pytest.raises(ValueError, match="standard"):
        fit_blocked(embeddings, hidden=[3], method="regular", semantics="reference", features="embedding", ids=[])
    with pytest.raises(ValueError, match="id columns"):
        fit_blocked(embeddings, hidden=[3], features="embedding", ids=[])
    with pytest.raises(ValueError, match="no rows"):
        fit_blocked(embeddings.where("vec_id < 0"), hidden=[3], method="regular", features="embedding", ids=[])
