"""Values recorded for the reference semantics, and the three-row training fixture."""

import numpy as np
import pytest

from layerstack import StackedAutoencoder, model_from_weights
from layerstack.operators.blocks import LayerSpec, layer_sums
from layerstack.operators.randoms import fixed_mask
from layerstack.operators.rules import Rules
from layerstack.plans.update import initial_decoder, initial_encoder, sparsity

ROW = (19 / 55, 1 / 2, 5 / 9)
ROWS = [ROW, (0.1, 0.9, 0.3), (0.8, 0.2, 0.6)]
REFERENCE = Rules.of("reference")

ENCODER_GRADIENT = [
    [0.051800203763718855, 0.10570060458570119, 0.08847317393656517, -0.06568157858044543],
    [0.01789461713963547, 0.036514756968530904, 0.03056346160890122, -0.022690001173275576],
    [0.0259001035045614, 0.05285030562207638, 0.04423658887753312, -0.03284079104703963],
    [0.028777892671749683, 0.058722561580015764, 0.049151765332045017, -0.03648976756043254],
]


def start():
    w = initial_encoder(3, 4, REFERENCE, 0, 1)
    return w, initial_decoder(w)


def test_initial_weights():
    w, s = start()
    assert (w[0] == 0).all()
    np.testing.assert_allclose(
        w[1:, 0], [-0.24008662272762094, -0.015483463962870737, 0.2803582109591105], rtol=1e-15
    )
    expected = [
        [-0.54315124, 0.18383725, 0.71572472],
        [-0.12654272, 0.56396352, -0.66046404],
        [0.54127723, 1.36266751, 0.49034148],
    ]
    np.testing.assert_allclose(w[1:, 1:], expected, atol=5e-9)
    np.testing.assert_array_equal(s[1:], w[1:].T)
    assert (s[0] == 0).all()


def test_fixed_mask():
    assert fixed_mask(16).astype(int).tolist() == [0, 1, 1, 0, 1, 1, 0, 0, 1, 1, 0, 1, 0, 1, 0, 1]


def test_sparse_gradient_entries():
    w, s = start()
    sums = layer_sums(np.array([ROW]), None, w, s, LayerSpec("sparse", REFERENCE))
    _, pull = sparsity(sums.active, 1, 0.05, 1e-4, REFERENCE.beta_power)
    g = sums.encoder + sums.lever * pull
    np.testing.assert_allclose(g, ENCODER_GRADIENT, atol=2e-8)
    assert round(g.sum(), 5) == 0.43288


def test_denoising_gradient_sum():
    w, s = start()
    sums = layer_sums(np.array([ROW]), None, w, s, LayerSpec("denoising", REFERENCE))
    assert round(sums.encoder.sum(), 5) == 0.30257


def test_tied_gradient_sum():
    """The recorded value of the tied decoder: the path through the encoder only."""
    w, s = start()
    spec = LayerSpec("denoising", REFERENCE, tied=True)
    sums = layer_sums(np.array([ROW]), None, w, s, spec)
    assert round(sums.encoder.sum(), 5) == 0.37155


@pytest.mark.parametrize(
    "at, plus, minus",
    [((0, 0), 2.3454567707530285, 2.345353170345501), ((0, 1), 2.345510673514667, 2.3452992723054957),
     ((3, 3), 2.3453684843509297, 2.3454414638860506)],
)
def test_recorded_costs(at, plus, minus):
    w, s = start()
    for by, cost in ((1e-3, plus), (-1e-3, minus)):
        v = w.copy()
        v[at] += by
        sums = layer_sums(np.array([ROW]), None, v, s, LayerSpec("sparse", REFERENCE))
        l2 = 1e-10 / 2 * (v[1:] ** 2).sum()
        assert abs(sums.loss + l2 - cost) < 1e-12


def test_check_gradients_of_the_recorded_row(spark):
    w, s = start()
    model = model_from_weights(
        spark, [w], [s], method="sparse", semantics="reference", beta=1e-4
    )
    df = spark.createDataFrame([(list(ROW),)], "features array<double>")
    rows = model.check_gradients(df).collect()
    assert len(rows) == 16 + 15
    encoder = {(r.i, r.j): r for r in rows if r.role == "encoder"}
    for (i, j), r in encoder.items():
        assert abs(r.numeric - ENCODER_GRADIENT[i][j]) < 1e-9
    assert round(sum(r.analytic for r in encoder.values()), 5) == 0.43288


TRAINING = {
    "regular": (
        [2.2916540673, 2.2084153386, 2.1709624794], [1.5364550410, 1.4646073041, 1.4322032048],
        (-0.5386912324, -1.7253937834),
    ),
    "denoising": (
        [2.2913432849, 2.1869660296, 2.1391304818], [1.4108411263, 1.3228727698, 1.2816093050],
        (-0.4769119151, -1.4020814870),
    ),
    "sparse": (
        [2.3015388956, 2.2175618204, 2.1797880974], [1.5438691451, 1.4714218530, 1.4387581640],
        (-0.5387461610, -1.7254173706),
    ),
}


@pytest.mark.parametrize("storage", ["cache", "table", "source"])
@pytest.mark.parametrize("method", list(TRAINING))
def test_training_fixture(spark, method, storage):
    df = spark.createDataFrame([(list(r),) for r in ROWS], "features array<double>")
    model = StackedAutoencoder(
        hidden=[2, 2], epochs=3, method=method, semantics="reference", scaling=False,
        beta=0.01 if method == "sparse" else 1e-10, storage=storage,
    ).fit(df)
    first, second, sums = TRAINING[method]
    history = model.history.orderBy("layer", "epoch").collect()
    np.testing.assert_allclose([r.loss for r in history], first + second, atol=1e-9)
    assert {r.m for r in history} == {3}
    np.testing.assert_allclose([w.sum() for w in model.weights], sums, atol=1e-9)
