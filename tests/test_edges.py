"""Inputs that must work, and inputs that must be refused."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from layerstack import (
    StackedAutoencoder,
    feature_profile,
    model_from_weights,
    read_features,
    scale_minmax,
    validate_features,
)
from layerstack.operators.blocks import LayerSpec, filled, layer_sums
from layerstack.operators.rules import Rules
from layerstack.plans.update import Descent
from layerstack.sources import write_libsvm

SCHEMA = "id bigint, features array<double>"


def table(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), SCHEMA)


def fit(df, **options):
    return StackedAutoencoder(**{"hidden": [2], "epochs": 2, "method": "regular", **options}).fit(df)


def test_single_row_and_empty_partitions(spark):
    df = table(spark, [[0.2, 0.4, 0.9]]).repartition(8)
    model = fit(df, scaling=False)
    assert model.history.select("m").distinct().collect()[0].m == 1
    assert len(model.encode(df).first().code) == 2


def test_zero_rows_zeros_and_ones(spark):
    df = table(spark, [[0.0, 0.0, 0.0], [1.0, 1.0, 1.0], [0.0, 1.0, 0.5]])
    model = fit(df, scaling=False)
    assert all(np.isfinite(w).all() for w in model.weights)
    assert all(np.isfinite(r.loss) for r in model.score(df).collect())


@pytest.mark.parametrize("storage", ["cache", "table"])
@pytest.mark.parametrize(
    "rows, message",
    [
        ([[0.1, 0.2], [0.1]], "differ in width"),
        ([[0.1, 0.2], None], "1 of 2 feature vectors are null"),
        ([[0.1, None], [0.1, 0.2]], "null or NaN"),
        ([[0.1, float("nan")], [0.1, 0.2]], "null or NaN"),
        ([[0.1, float("inf")], [0.1, 0.2]], "infinite"),
        ([[0.1, 1.2], [0.1, 0.2]], "outside"),
        ([[-0.1, 0.2], [0.1, 0.2]], "outside"),
        ([], "no rows"),
        ([[], []], "empty"),
    ],
)
def test_refused_tables(spark, rows, message, storage):
    with pytest.raises(ValueError, match=message):
        fit(table(spark, rows), scaling=False, storage=storage)
    with pytest.raises(ValueError, match=message):
        fit(table(spark, rows), scaling=False, epochs=0)


@pytest.mark.parametrize(
    "options",
    [
        {"method": "other"}, {"semantics": "other"}, {"activation": "other"},
        {"decoder": "other"}, {"storage": "other"}, {"hidden": []}, {"hidden": [0]},
        {"epochs": -1}, {"method": "denoising"}, {"method": "denoising", "corruption": 1.0},
        {"sparsity": 0.0}, {"activation": "relu", "hidden": [2, 2]},
        {"activation": "tanh", "method": "sparse"}, {"numFeatures": 7},
    ],
)
def test_refused_options(spark, options):
    with pytest.raises(ValueError):
        fit(table(spark, [[0.1, 0.2], [0.3, 0.4]]), **options)


def test_unknown_option_is_refused():
    with pytest.raises(TypeError):
        StackedAutoencoder(layers=[2])


def test_wrong_width_when_scoring(spark):
    model = fit(table(spark, [[0.1, 0.2], [0.3, 0.4]]), scaling=False)
    with pytest.raises(Exception, match="must have 2 features"):
        model.encode(table(spark, [[0.1, 0.2, 0.3]])).collect()


def test_null_rows_stay_null_when_scoring(spark):
    df = table(spark, [[0.1, 0.2], [0.3, 0.4]])
    model = fit(df, scaling=False)
    mixed = table(spark, [[0.1, 0.2], None, [0.3, 0.4]]).coalesce(1).orderBy("id")
    rows = model.score(model.reconstruct(model.encode(mixed))).orderBy("id").collect()
    assert rows[1].code is None and rows[1].loss is None and rows[1].reconstruction is None
    expected = model.encode(df).orderBy("id").collect()
    assert [rows[0].code, rows[2].code] == [r.code for r in expected]


def test_vectors_with_a_null_element_give_null(spark):
    df = table(spark, [[0.1, 0.2], [0.3, 0.4]])
    model = fit(df, scaling=False)
    mixed = table(spark, [[0.1, 0.2], None, [0.3, None], [], [0.3, 0.4], [None, None]]).where("id <> 3")
    rows = model.score(model.encode(mixed.coalesce(1))).orderBy("id").collect()
    assert [r.code is None for r in rows] == [r.loss is None for r in rows] == [
        False, True, True, False, True]
    assert rows[0].code == model.encode(df).orderBy("id").first().code
    nan = model.score(table(spark, [[float("nan"), 0.2]])).first()
    assert np.isnan(nan.loss)
    columns = fit(df.select("id", F.col("features")[0].alias("a"), F.col("features")[1].alias("b")),
                  inputCols=["a", "b"], scaling=False)
    assert columns.encode(spark.sql("SELECT 1.0D a, CAST(NULL AS DOUBLE) b")).first().code is None


def test_values_outside_the_trained_range(spark):
    df = table(spark, [[1.0, 10.0], [3.0, 20.0]])
    far, edge = table(spark, [[5.0, 15.0], [0.0, 25.0]]), table(spark, [[3.0, 15.0], [1.0, 20.0]])
    model = fit(df)
    clip = model.copy({model.outside: "clip"})
    losses = [r.loss for r in clip.score(far).orderBy("id").collect()]
    assert losses == [r.loss for r in model.score(edge).orderBy("id").collect()]
    assert losses != [r.loss for r in model.score(far).orderBy("id").collect()]
    g, expected = ({(r.role, r.i, r.j): r.g for r in m.gradients(d).collect()}
                   for m, d in ((clip, far), (model, edge)))
    assert g == pytest.approx(expected, abs=1e-12)
    strict = model.copy({model.outside: "error"})
    assert strict.score(edge).count() == 2
    with pytest.raises(Exception, match="outside the trained range"):
        strict.score(far).collect()


@pytest.mark.parametrize("method, decoder", [("denoising", "separate"), ("sparse", "tied")])
def test_training_goes_on_after_a_failure(spark, tmp_path, monkeypatch, method, decoder):
    from layerstack.plans import training

    rng = np.random.default_rng(5)
    df = table(spark, rng.random((60, 5)).tolist()).repartition(3)
    options = dict(hidden=[3, 2], epochs=4, method=method, decoder=decoder, idCols=["id"])
    whole = fit(df, **options)
    options |= {"progressFolder": str(tmp_path / "progress"), "progressEpochs": 1}
    seen, real = [], training.epoch_sums

    def failing(source, w, s, spec, *more):
        seen.append((spec.layer, spec.epoch))
        if (spec.layer, spec.epoch) == (2, 2) and seen.count((2, 2)) == 1:
            raise RuntimeError("lost")
        return real(source, w, s, spec, *more)

    monkeypatch.setattr(training, "epoch_sums", failing)
    with pytest.raises(RuntimeError, match="lost"):
        fit(df, **options)
    seen_before = len(seen)
    again = fit(df, **options)
    assert seen[seen_before:] == [(2, 2), (2, 3)]
    for a, b in zip(whole.weights + whole.decoders, again.weights + again.decoders):
        np.testing.assert_allclose(a, b, rtol=0, atol=1e-12)
    assert [(r.layer, r.epoch) for r in again.history.collect()] == [
        (r.layer, r.epoch) for r in whole.history.collect()]
    # A finished run's state gives the model at once; other options are refused.
    done = len(seen)
    np.testing.assert_array_equal(fit(df, **options).weights[1], again.weights[1])
    assert len(seen) == done
    with pytest.raises(ValueError, match="other options"):
        fit(df, **{**options, "learning": 0.2})


def test_nudges_of_a_unit_equal_single_nudges():
    from layerstack.operators import gradients
    from layerstack.operators.blocks import activate, cross_entropy, decode_input, sigmoid

    rng = np.random.default_rng(2)
    x, w, s = rng.random((7, 4)), rng.normal(size=(5, 3)), rng.normal(size=(4, 4))

    def loss(w, s, tied):
        h = activate(x @ w[1:] + w[0], "sigmoid")
        p = sigmoid(decode_input(h, w, s, tied))
        return cross_entropy(x, p, True).sum(), h.sum(axis=0)

    for tied in (False, True):
        enc, dec = np.zeros((6, 5, 3)), np.zeros((3, 4, 4))
        spec = LayerSpec("regular", Rules.of("standard"), tied=tied)
        gradients._Nudged(x, None, w, s, spec).add_to(enc, dec, 0.1)
        for i, j in np.ndindex(*w.shape):
            for side, by in ((0, 0.1), (1, -0.1)):
                moved = w.copy()
                moved[i, j] += by
                total, active = loss(moved, s, tied)
                assert enc[2 + side, i, j] == pytest.approx(total, abs=1e-9)
                assert enc[4 + side, i, j] == pytest.approx(active[j], abs=1e-9)
        if not tied:
            for i, j in np.ndindex(*s.shape):
                up, down = s.copy(), s.copy()
                up[i, j] += 0.1
                down[i, j] -= 0.1
                # Only the moved output's loss is summed; that of the others cancels.
                assert dec[1, i, j] - dec[2, i, j] == pytest.approx(
                    loss(w, up, tied)[0] - loss(w, down, tied)[0], abs=1e-9)


def test_saturated_units_keep_the_loss_finite(spark):
    w = np.array([[800.0, -800.0], [0.0, 0.0]])
    s = np.array([[0.0], [800.0], [-800.0]])
    df = table(spark, [[0.0], [0.5]])
    model = model_from_weights(spark, [w], [s], method="regular")
    assert all(np.isfinite(r.loss) for r in model.score(df).collect())
    codes = {tuple(r.code) for r in model.encode(df).collect()}
    assert codes == {(1.0, 0.0)}


def test_zero_gradient_does_not_divide_by_zero():
    d = Descent(np.zeros((3, 2)), 0.1, 0.0, Rules.of("standard"))
    d.step(np.zeros((3, 2)), 5.0)
    assert (d.theta == 0).all()


def test_constant_feature_scales_to_zero(spark):
    df = table(spark, [[3.0, 1.0], [3.0, 2.0]])
    rows = scale_minmax(df, "features").orderBy("id").collect()
    assert [r.scaled for r in rows] == [[0.0, 0.0], [0.0, 1.0]]
    model = fit(df)
    back = model.reconstruct(df, original_units=True).first().reconstruction
    assert back[0] == 3.0


def test_profile_and_validation_counts(spark):
    rows = [[0.5, 2.0, None], [float("nan"), -1.0], None, [0.25, 0.75, 1.0]]
    df = table(spark, rows).repartition(3)
    profile = {r.feature: r for r in feature_profile(df, "features").collect()}
    assert (profile[-1].n, profile[-1].bad) == (4, 1)
    assert (profile[0].lo, profile[0].hi, profile[0].n, profile[0].bad) == (0.25, 0.5, 3, 1)
    assert (profile[1].lo, profile[1].hi, profile[1].n, profile[1].bad) == (-1.0, 2.0, 3, 0)
    assert (profile[2].lo, profile[2].n, profile[2].bad) == (1.0, 2, 1)
    v = validate_features(df, "features").first()
    assert (v.rows, v.null_rows, v.min_width, v.max_width) == (4, 1, 2, 3)
    assert (v.bad_values, v.outside) == (2, 2)


def test_vector_columns_and_libsvm(spark, tmp_path):
    dense = [[0.0, 0.5, 1.0], [0.25, 0.0, 0.0], [1.0, 1.0, 0.5]]
    df = table(spark, dense)
    vectors = spark.createDataFrame([(i, Vectors.dense(r).toArray().tolist()) for i, r in
                                     enumerate(dense)], SCHEMA)
    from pyspark.ml.functions import array_to_vector
    vectors = vectors.withColumn("features", array_to_vector("features"))
    path = str(tmp_path / "svm")
    write_libsvm(df.withColumn("y", F.col("id") % 2), path, "y", "features")
    text = {r.value for r in spark.read.text(path).collect()}
    assert "0.0 2:0.5 3:1.0" in text and "1.0 1:0.25" in text
    loaded = read_features(spark, path, "libsvm")
    assert loaded.schema["features"].dataType.simpleString() == "array<double>"
    models = [fit(d, scaling=False) for d in (df, vectors, loaded)]
    for other in models[1:]:
        np.testing.assert_allclose(models[0].weights[0], other.weights[0], atol=1e-12)


@pytest.mark.parametrize("storage", ["cache", "table", "source"])
def test_sparse_vectors_train_as_dense_ones(spark, tmp_path, storage):
    rng = np.random.default_rng(7)
    dense = np.where(rng.random((200, 40)) < 0.1, rng.random((200, 40)), 0.0)
    dense[3] = 0.0
    path = str(tmp_path / "svm")
    df = table(spark, dense.tolist())
    write_libsvm(df.withColumn("y", F.col("id")), path, "y", "features")
    sparse = read_features(spark, path, "libsvm", num_features=40, sparse=True)
    assert sparse.schema["features"].dataType.typeName() == "vectorudt"
    options = dict(storage=storage, hidden=[3, 2], method="denoising")
    # Rows are masked by their key, which is of the same type on both sides.
    a = fit(df.withColumn("y", F.col("id").cast("double")), idCols=["y"], **options)
    b = fit(sparse.withColumnRenamed("label", "y").repartition(3), idCols=["y"], **options)
    for x, y in zip(a.weights, b.weights):
        np.testing.assert_allclose(x, y, atol=1e-12)
    assert b.encode(sparse).count() == 200
    assert b.mean_activation(sparse).count() == 2


def test_stored_vectors_follow_their_values(spark):
    from layerstack.operators.tables import pack_vectors, vector_block_source

    rows = [(i, Vectors.sparse(5000, [i, i + 7], [1.0, 0.5])) for i in range(300)]
    rows += [(300, Vectors.dense([0.25] * 5000))]
    df = spark.createDataFrame(rows, ["id", "features"]).coalesce(1)
    blocks = pack_vectors(df, "features", ["id"])
    stored = blocks.agg(F.sum(F.length("x"))).first()[0]
    assert stored < 100_000 < 301 * 5000 * 8
    source = vector_block_source(blocks, 5000, None)
    batches = iter(source.df.toArrow().to_batches())
    found = [(x, k) for x, k in source.read(batches)]
    whole = np.concatenate([filled(x) for x, _ in found])
    np.testing.assert_array_equal(whole, np.array([v.toArray() for _, v in rows]))
    assert sum(len(k) for _, k in found) == 301
    with pytest.raises(ValueError, match="1 of 302 feature vectors are null"):
        fit(df.union(spark.createDataFrame([(301, None)], df.schema)), scaling=False)
    with pytest.raises(ValueError, match="differ in width"):
        fit(df.union(spark.createDataFrame([(301, Vectors.dense([1.0]))], df.schema)))


def test_libsvm_with_known_width(spark, tmp_path):
    path = str(tmp_path / "svm")
    write_libsvm(table(spark, [[0.5, 0.0, 0.0]]).withColumn("y", F.lit(1)), path, "y", "features")
    assert read_features(spark, path, "libsvm", num_features=3).first().features == [0.5, 0, 0]


def test_integer_arrays_and_columns(spark):
    df = spark.createDataFrame([(1, [0, 1]), (2, [1, 0]), (3, [1, 1])], "id int, features array<int>")
    wide = df.select(F.col("features")[0].alias("a"), F.col("features")[1].alias("b"))
    a, b = fit(df), fit(wide, inputCols=["a", "b"])
    np.testing.assert_allclose(a.weights[0], b.weights[0], atol=1e-12)


def test_sparse_lever_gives_the_two_pass_gradient():
    """The single-pass form equals adding the constant to every row's hidden error."""
    rng = np.random.default_rng(3)
    x, w, s = rng.random((9, 4)), rng.normal(size=(5, 3)), rng.normal(size=(4, 4))
    pull = rng.normal(size=3)
    sums = layer_sums(x, None, w, s, LayerSpec("sparse", Rules.of("standard")))
    h = 1 / (1 + np.exp(-(x @ w[1:] + w[0])))
    e = 1 / (1 + np.exp(-(h @ s[1:] + s[0]))) - x
    hidden = (e @ s[1:].T + pull) * h * (1 - h)
    expected = np.concatenate([hidden.sum(axis=0)[None], x.T @ hidden])
    np.testing.assert_allclose(sums.encoder + pull * sums.lever, expected, atol=1e-12)
