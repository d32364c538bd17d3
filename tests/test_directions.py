"""Slopes along random directions, and profiles cut into chunks."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from layerstack import StackedAutoencoder, feature_profile
from layerstack.operators import profile as pr
from layerstack.operators.gradients import direction
from layerstack.sources.weights import import_text


@pytest.mark.parametrize(
    "method,activation",
    [("regular", "sigmoid"), ("denoising", "sigmoid"), ("sparse", "sigmoid"), ("regular", "tanh"), ("denoising", "tanh")],
)
@pytest.mark.parametrize("tied", [False, True])
def test_gradients_are_slopes(embeddings, method, tied, activation):
    model = StackedAutoencoder(
        featuresCol="embedding", idCols=["vec_id"], hidden=[5], method=method, epochs=0, beta=0.05,
        sparsity=0.2, lmbda=0.01, decoder="tied" if tied else "separate", activation=activation,
    ).fit(embeddings)
    rows = model.check_directions(embeddings.repartition(5), directions=3).orderBy("direction").collect()
    assert [r.direction for r in rows] == [0, 1, 2]
    assert all(r.difference < 1e-5 and abs(r.analytic) > 1e-4 for r in rows)


def test_second_layer_and_analytic_side(embeddings):
    """The analytic slope is the product of `gradients` and the direction."""
    model = StackedAutoencoder(
        featuresCol="embedding", idCols=["vec_id"], hidden=[6, 3], method="regular", epochs=2, lmbda=0.01,
    ).fit(embeddings)
    (row,) = model.check_directions(embeddings, directions=1, seed=4).collect()
    w, s = direction((6, 3), 0, 4, False)
    assert abs((w**2).sum() + (s**2).sum() - 1) < 1e-12
    total, m = 0.0, None
    for r in model.gradients(embeddings).collect():
        total, m = total + r.g * (w if r.role == "encoder" else s)[r.i, r.j], r.m
    total = total / m + 0.01 * ((model.weights[1][1:] * w[1:]).sum() + (model.decoders[1][1:] * s[1:]).sum())
    assert abs(row.analytic - total) < 1e-12 and row.difference < 1e-6
    with pytest.raises(ValueError):
        model.check_directions(embeddings, directions=0)


def test_a_wrong_gradient_is_noticed(embeddings, monkeypatch):
    """The reference's tied gradient leaves out a path, so it is no slope."""
    model = StackedAutoencoder(
        featuresCol="embedding", idCols=["vec_id"], hidden=[5], method="denoising", epochs=0,
        semantics="reference", decoder="tied",
    ).fit(embeddings)
    rows = model.check_directions(embeddings, directions=4).collect()
    assert max(r.difference for r in rows) > 1e-3


@pytest.mark.parametrize("chunk", [1, 3, 1 << 15])
def test_chunked_profiles(spark, monkeypatch, chunk):
    monkeypatch.setattr(pr, "CHUNK_FEATURES", chunk)
    rng = np.random.default_rng(2)
    rows = [rng.normal(size=7).tolist() for _ in range(50)]
    rows += [None, [1.0], [float("nan"), 2.0, 9.0], [], [None, 1.0]]
    df = spark.createDataFrame([(r,) for r in rows], "x array<double>").repartition(6)
    got = {r.feature: tuple(r)[1:] for r in feature_profile(df, "x").collect()}
    assert got.pop(-1) == (None, None, 55, 1)
    assert sorted(got) == list(range(7))
    for i in range(7):
        held = [r[i] for r in rows if r is not None and len(r) > i]
        good = [v for v in held if v is not None and v == v]
        assert got[i] == (min(good), max(good), len(held), len(held) - len(good))


def test_profiles_of_vectors(spark, monkeypatch):
    monkeypatch.setattr(pr, "CHUNK_FEATURES", 4)
    rows = [
        Vectors.sparse(6, [1, 4], [2.0, -1.0]), Vectors.sparse(6, [1], [3.0]), Vectors.dense([1.0, 2, 3, 4, 5, 6]),
        Vectors.sparse(6, [], []), None, Vectors.sparse(6, [1, 5], [1.0, float("nan")]), Vectors.sparse(2, [0], [7.0]),
    ]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], ["id", "x"]).repartition(3)
    got = {r.feature: tuple(r)[1:] for r in feature_profile(df, "x").collect()}
    assert got[-1] == (None, None, 7, 1)
    assert got[0] == (0.0, 7.0, 6, 0) and got[1] == (0.0, 3.0, 6, 0) and got[4] == (-1.0, 5.0, 5, 0)
    assert got[2] == (0.0, 3.0, 5, 0) and got[5] == (0.0, 6.0, 5, 1)


def test_text_in_parts(spark, embeddings, tmp_path):
    """Parts in the order of their names are the text, and read back as the same weights."""
    from layerstack.sources import weights as files

    model = StackedAutoencoder(featuresCol="embedding", hidden=[5, 2], method="regular", epochs=1).fit(embeddings)
    one = files.export_text(spark, model.weights, str(tmp_path / "one"), "w")
    many = files.export_text(spark, model.weights, str(tmp_path / "many"), "w", part_lines=50)
    read = lambda path: [
        p.read_text() for p in sorted((tmp_path / path.split("/")[-2] / path.split("/")[-1]).glob("part-*"))
    ]
    assert len(read(one)) == 1 and len(read(many)) == 7
    assert "".join(read(many)) == read(one)[0]
    for path in (one, many):
        for a, b in zip(import_text(spark, path), model.weights):
            np.testing.assert_array_equal(a, b)
    (part,) = (tmp_path / "one" / one.split("/")[-1]).glob("part-*")
    (tmp_path / "many" / many.split("/")[-1] / "part-00099-again.txt").write_text(part.read_text())
    with pytest.raises(ValueError, match="header"):
        import_text(spark, many)
