"""Sparse blocks against the same blocks filled with zeros."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import vector_to_array

from layerstack import StackedAutoencoder
from layerstack.operators import sparse
from layerstack.operators.blocks import LayerSpec, encode_layer, layer_sums, sparse_masked
from layerstack.operators.rules import Rules
from layerstack.operators.sparse import SparseInput, SparseRows
from layerstack.operators.tables import pack_vectors, vector_block_source, vector_source


def block(seed=0, rows=40, width=30, share=0.08, low=0.0):
    rng = np.random.default_rng(seed)
    x = np.where(rng.random((rows, width)) < share, rng.uniform(low, 3.0, (rows, width)), 0.0)
    x[:, 3] = 0.0  # a constant feature
    x[5] = 0.0  # an empty row
    x[0, 1], x[1, 1] = 3.0, 2.0
    starts = np.concatenate([[0], np.cumsum((x != 0).sum(1))])
    return x, SparseRows(starts, np.nonzero(x)[1], x[np.nonzero(x)], width)


def scaled(x):
    lo, hi = x.min(0), x.max(0)
    return (x - lo) / np.where(hi > lo, hi - lo, 1.0), (lo, hi)


@pytest.mark.parametrize("cells", [1, 50, 1 << 20])
def test_products(monkeypatch, cells):
    monkeypatch.setattr(sparse, "GATHERED_CELLS", cells)
    x, rows = block()
    rng = np.random.default_rng(1)
    right, left = rng.normal(size=(30, 7)), rng.normal(size=(40, 5))
    assert np.allclose(rows.times(right), x @ right)
    assert np.allclose(rows.transposed_times(left), x.T @ left)
    assert np.array_equal(rows.slice(10, 9).dense(), x[10:19])
    assert np.allclose(rows.slice(5, 1).times(right), 0) and rows.slice(3, 0).times(right).shape == (0, 7)


@pytest.mark.parametrize("low", [0.0, -2.0])
@pytest.mark.parametrize("method", ["regular", "denoising", "sparse"])
@pytest.mark.parametrize("tied", [False, True])
def test_layer_sums(monkeypatch, low, method, tied):
    x, rows = block(2, low=low)
    dense, ranges = scaled(x)
    monkeypatch.setattr("layerstack.operators.blocks.SPARSE_SHARE", 1.0)
    rng = np.random.default_rng(3)
    w, s = rng.normal(size=(31, 6)), rng.normal(size=(7, 30))
    keys = rng.integers(-(1 << 62), 1 << 62, 40)
    spec = LayerSpec(method, Rules.of("standard"), tied=tied, epoch=2, seed=5, corruption=0.4)
    thin = SparseInput.scaled(rows, ranges)
    assert np.allclose(thin.dense(), dense)
    a, b = layer_sums(thin, keys, w, s, spec), layer_sums(dense, keys, w, s, spec)
    assert np.isclose(a.loss, b.loss) and a.rows == b.rows
    for name in ("encoder", "decoder", "active", "lever"):
        assert np.allclose(getattr(a, name), getattr(b, name)), name
    assert np.allclose(encode_layer(thin, w, spec), encode_layer(dense, w, spec))


def test_no_scaling():
    x, rows = block(4)
    assert np.allclose(SparseInput.scaled(rows, None).dense(), x)


def test_filled_where_needed():
    """Rules whose infinities come from zeros, and masks that make many columns dense."""
    x, rows = block(5, low=-2.0)
    thin = SparseInput.scaled(rows, scaled(x)[1])
    keys = np.arange(40)
    assert sparse_masked(thin, keys, LayerSpec("regular", Rules.of("reference"))) is None
    assert sparse_masked(thin, keys, LayerSpec("denoising", Rules.of("standard"))) is None
    assert sparse_masked(thin, keys, LayerSpec("regular", Rules.of("standard"))) is thin
    spec = LayerSpec("denoising", Rules.of("reference"))
    w, s = np.random.default_rng(6).normal(size=(31, 4)), np.zeros((5, 30))
    a, b = layer_sums(thin, keys, w, s, spec), layer_sums(thin.dense(), keys, w, s, spec)
    assert a.loss == b.loss and np.array_equal(a.encoder, b.encoder)
    assert np.allclose(encode_layer(thin, w, spec), encode_layer(thin.dense(), w, spec))


def vectors(rows):
    kinds = [("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())),
             ("values", pa.list_(pa.float64()))]
    return pa.array(rows, pa.struct(kinds))


def test_vectors():
    column = vectors([
        {"type": 0, "size": 4, "indices": [1, 3], "values": [2.0, 5.0]},
        {"type": 1, "size": None, "indices": None, "values": [1.0, 0.0, 2.0, 3.0]},
        {"type": 0, "size": 4, "indices": [], "values": []},
    ])
    want = [[0, 2, 0, 5], [1, 0, 2, 3], [0, 0, 0, 0]]
    assert sparse.vector_rows(column, 4).dense().tolist() == want
    assert sparse.vector_rows(column.slice(1), 4).dense().tolist() == want[1:]
    with pytest.raises(ValueError, match="must have 5"):
        sparse.vector_rows(column, 5)
    with pytest.raises(ValueError, match="null"):
        sparse.vector_rows(vectors([None]), 4)
    blocks = list(sparse.sparse_inputs(column, 4, None, 2))
    assert isinstance(blocks[0], np.ndarray) and isinstance(blocks[1], SparseInput)


def wide(spark, n=300):
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(7)
    rows = []
    for i in range(n):
        at = sorted(rng.choice(5000, 20, replace=False).tolist())
        rows.append((i, Vectors.sparse(5000, at, rng.uniform(0.5, 2.0, 20).tolist())))
    rows += [(900, None), (901, None)]
    return spark.createDataFrame(rows, ["id", "features"])


@pytest.mark.parametrize("storage", ["auto", "source"])
def test_training_on_wide_rows(spark, storage):
    df = wide(spark)
    good = df.where("features IS NOT NULL")
    for method in ("regular", "denoising", "sparse"):
        options = dict(idCols=["id"], hidden=[4], method=method, epochs=3, storage=storage)
        model = StackedAutoencoder(featuresCol="features", **options).fit(good)
        filled = good.withColumn("features", vector_to_array("features"))
        other = StackedAutoencoder(featuresCol="features", **options).fit(filled)
        for a, b in zip(model.history.collect(), other.history.collect()):
            assert np.isclose(a.loss, b.loss)
        assert np.allclose(model.weights[0], other.weights[0])
    codes = model.encode(df).orderBy("id").collect()
    assert all(r.code is None for r in codes[-2:])
    want = other.encode(filled).orderBy("id").collect()
    assert np.allclose([r.code for r in codes[:-2]], [r.code for r in want])
    assert np.allclose(
        [r.loss for r in model.score(good).orderBy("id").collect()],
        [r.loss for r in other.score(filled).orderBy("id").collect()],
    )
    assert model.encode(df.where("id > 899")).count() == 2


@pytest.mark.parametrize("packed", [False, True])
def test_blocks_stay_sparse(spark, packed):
    """What a task reads: sparse rows, as long as nothing has to be clipped."""
    df = wide(spark).where("features IS NOT NULL")
    ranges = np.zeros(5000), np.full(5000, 2.0)
    source = vector_source(df, "features", 5000, ranges, ["id"])
    if packed:
        source = vector_block_source(pack_vectors(df, "features", ["id"]), 5000, ranges)
    batches = source.df.toArrow().to_batches()
    blocks = list(source.read(iter(batches)))
    assert sum(len(x) for x, _ in blocks) == sum(len(k) for _, k in blocks) == 300
    assert all(isinstance(x, SparseInput) for x, _ in blocks)
    clipped = vector_source(df, "features", 5000, ranges, [], outside="clip")
    assert all(isinstance(x, np.ndarray) for x, _ in clipped.read(iter(clipped.df.toArrow().to_batches())))
