"""Results must not depend on partitioning, storage or the way sums are added up."""

import contextlib
import io
import math
from dataclasses import replace
from pathlib import Path

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from layerstack import (
    StackedAutoencoder,
    StackedAutoencoderModel,
    assemble_weights,
    corrupt,
    flatten_weights,
    import_text,
    model_from_weights,
    model_table,
)
from layerstack import functions as fn
from layerstack.operators import blocks
from layerstack.operators.matrices import matrices_of
from layerstack.operators.randoms import hash_mask, keep_threshold
from layerstack.operators.sums import PARTIAL_SCHEMA, sum_blocks, tree_layout, tree_totals
from layerstack.operators.tables import (
    block_source,
    heaviest_task,
    pack,
    pass_tasks,
    vector_source,
)
from layerstack.plans.training import BlockStore, Settings, train
from layerstack.plans.update import sparsity

METHODS = ["regular", "denoising", "sparse"]
SOURCE = {"featuresCol": "embedding", "idCols": ["vec_id"]}


def fit(df, **options):
    options = {"hidden": [6, 3], "epochs": 3, "beta": 0.05, **SOURCE, **options}
    return StackedAutoencoder(**options).fit(df)


@pytest.mark.parametrize("method", METHODS)
def test_partitioning_does_not_matter(embeddings, method):
    models = [
        fit(embeddings.repartition(n), method=method, storage=storage)
        for n, storage in ((1, "cache"), (3, "table"), (8, "auto"))
    ]
    for other in models[1:]:
        for a, b in zip(models[0].weights + models[0].decoders, other.weights + other.decoders):
            np.testing.assert_allclose(a, b, atol=1e-9)
        a, b = (
            [r.loss for r in m.history.orderBy("layer", "epoch").collect()]
            for m in (models[0], other)
        )
        np.testing.assert_allclose(a, b, rtol=1e-12)


@pytest.mark.parametrize("method", METHODS)
def test_loss_falls(embeddings, method):
    model = fit(embeddings, method=method, epochs=8, hidden=[6])
    losses = [r.loss for r in model.history.orderBy("epoch").collect()]
    assert losses[-1] < losses[0]


def test_shuffled_sums_equal_collected_ones(embeddings):
    settings = Settings(
        features="embedding", ids=["vec_id"], hidden=[6, 3], method="sparse", epochs=3,
        beta=0.05, storage="cache",
    )
    small = replace(settings, collect_bytes=5000, reduce_bytes=3000)
    df = embeddings.repartition(8)
    direct, direct_reports = train(df, settings)
    shuffled, shuffled_reports = train(df, small)
    for a, b in zip(direct.weights, shuffled.weights):
        np.testing.assert_allclose(a, b, atol=1e-10)
    np.testing.assert_allclose(
        [r.loss for r in direct_reports], [r.loss for r in shuffled_reports], rtol=1e-12
    )


def test_tree_layout_bounds():
    for size in (7, 100, 3_000, 20_000_000, 1 << 33):
        length, fan = tree_layout(size, 256 << 20)
        assert 1 <= length <= size and fan >= 2
        assert fan * length * 8 <= 256 << 20 and (length == size or fan == 32)
    assert tree_layout(100_000, 3000) == (1024, 2)


@pytest.mark.parametrize("parts,fan", [(1, 2), (2, 2), (37, 3), (64, 4), (50, 100)])
def test_tree_totals(spark, parts, fan):
    """Every partial of every chunk counts once, and no group is larger than the fan."""
    rng = np.random.default_rng(parts)
    values = rng.normal(size=(3, parts, 5))
    rows = [(c, 0, p, values[c, p].tobytes()) for c in range(3) for p in range(parts)]
    df = spark.createDataFrame(rows, PARTIAL_SCHEMA).repartition(4)
    totals = tree_totals(df, parts, 3, fan)
    got = {r.chunk: np.frombuffer(r.v) for r in totals.collect()}
    assert sorted(got) == [0, 1, 2]
    for c in range(3):
        np.testing.assert_allclose(got[c], values[c].sum(axis=0))
    levels = 1 if parts <= fan else math.ceil(math.log(parts) / math.log(fan) - 1e-9)
    assert totals._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == levels
    with pytest.raises(ValueError):
        tree_totals(df, parts, 3, 1)


def test_tasks_follow_splits(spark):
    bound = max(4096, 4 * spark.sparkContext.defaultParallelism)
    assert pass_tasks(spark, 100, 10, 1 << 30) == 100
    assert pass_tasks(spark, 800_000, 1 << 30, 1 << 30) == bound
    # 100 TB of doubles in splits of 128 MB: a task each, as long as partial sums are small beside them.
    assert pass_tasks(spark, 800_000, 100 << 37, 100_000) == 800_000
    assert bound < pass_tasks(spark, 800_000, 100 << 37, 10_000_000) < 800_000
    assert pass_tasks(spark, 800_000, 100 << 37, 100_000, requested=50) == 50
    assert pass_tasks(spark, 0, 0, 0) == 1


def test_task_bound_limits_partials(spark, embeddings):
    df = embeddings.repartition(8)
    source = vector_source(df, "embedding", 64, None, [])

    def add(total, x, keys):
        total[0] += len(x)
        total[1] += 1e-9 + x.sum()

    sums = [sum_blocks(source, 2, add, n) for n in (8, 3, 1)]
    assert {s[0] for s in sums} == {float(embeddings.count())}
    np.testing.assert_allclose([s[1] for s in sums], sums[0][1], atol=1e-6)
    assert source.narrowed(3).rdd.getNumPartitions() == 3
    model = fit(df, method="regular", maxTasks=2)
    again = fit(df, method="regular")
    np.testing.assert_allclose(model.weights[1], again.weights[1], atol=1e-10)


def test_blocks_hold_every_row_in_source_type(embeddings):
    blocks = pack(embeddings.repartition(5), "embedding", ["vec_id"])
    source = block_source(blocks, 64, "f4", None)

    def add(total, x, keys):
        assert x.dtype == np.float64 and len(keys) == len(x)
        total[0] += len(x)
        total[1:] += x.sum(axis=0)

    total = sum_blocks(source, 65, add, 100)
    sums = (
        embeddings.select(F.posexplode("embedding").alias("i", "v"))
        .groupBy("i").agg(F.sum(F.col("v").cast("double"))).orderBy("i").collect()
    )
    assert total[0] == embeddings.count()
    np.testing.assert_allclose(total[1:], [r[1] for r in sums], atol=1e-9)


def test_uneven_tables_are_redistributed(spark):
    rows = spark.range(0, 60_000, 1, 1).select(
        F.array(*[F.rand(i) for i in range(16)]).alias("features"), "id"
    )
    lumpy = rows.union(rows.limit(10).repartition(3))
    stack, _ = train(
        lumpy, Settings("features", [], [4], method="regular", epochs=1, storage="cache")
    )
    blocks = pack(lumpy, "features", [])
    most, total = heaviest_task(blocks, 4096)
    assert total == 60_010 and most >= 59_000
    even = blocks.repartition(8)
    assert heaviest_task(even, 4096)[0] < total / 4
    assert stack.weights[0].shape == (17, 4)


def test_column_mask_equals_training_mask(spark, embeddings):
    ones = embeddings.select("vec_id", F.transform("embedding", lambda v: F.lit(1.0)).alias("x"))
    words = [F.lit(v).cast("bigint") for v in (2, 4, 5)]
    threshold = keep_threshold(0.3)
    in_sql = F.transform("x", lambda v, i: F.when(
        F.xxhash64("key", *words, i.cast("bigint")) >= threshold, v).otherwise(0.0))
    rows = (
        corrupt(ones, "x", ids=["vec_id"], drop=0.3, seed=5, layer=2, epoch=4)
        .withColumn("key", F.xxhash64("vec_id")).withColumn("in_sql", in_sql).collect()
    )
    masks = hash_mask(np.array([r.key for r in rows]), 64, 0.3, 2, 4, 5)
    np.testing.assert_array_equal(np.array([r.corrupted for r in rows]), masks.astype(float))
    assert [r.corrupted for r in rows] == [r.in_sql for r in rows]
    assert abs(masks.mean() - 0.7) < 0.02


def test_mask_changes_with_row_layer_and_epoch():
    keys = np.arange(200) * 7919
    base = hash_mask(keys, 32, 0.5, 1, 0, 0)
    for other in (
        hash_mask(keys + 1, 32, 0.5, 1, 0, 0), hash_mask(keys, 32, 0.5, 2, 0, 0),
        hash_mask(keys, 32, 0.5, 1, 1, 0), hash_mask(keys, 32, 0.5, 1, 0, 1),
    ):
        assert 0.45 < (base != other).mean() < 0.55
    assert hash_mask(keys, 32, 0.0, 1, 0, 0).all()


@pytest.mark.parametrize("semantics", ["standard", "reference"])
def test_scores_average_to_the_next_training_loss(embeddings, semantics):
    """A model of t epochs scores the table with the loss that epoch t + 1 reports."""
    options = {"method": "regular", "hidden": [5], "semantics": semantics}
    short = fit(embeddings, epochs=2, **options)
    long = fit(embeddings, epochs=3, **options)
    mean = short.score(embeddings).agg(F.avg("loss")).first()[0]
    assert abs(mean - long.history.where("epoch = 2").first().loss) < 1e-9


def test_second_layer_scores_match_training(embeddings):
    short = fit(embeddings, method="denoising", semantics="reference", epochs=2)
    mean = short.score(embeddings, upto=1).agg(F.avg("loss")).first()[0]
    long = fit(embeddings, method="denoising", semantics="reference", epochs=3)
    assert abs(mean - long.history.where("layer = 1 AND epoch = 2").first().loss) < 1e-9


@pytest.mark.parametrize("decoder", ["separate", "tied"])
@pytest.mark.parametrize("method", METHODS)
def test_gradients_match_differences(embeddings, method, decoder):
    model = fit(embeddings.limit(40), method=method, epochs=1, decoder=decoder)
    for layer in (1, 2):
        rows = model.check_gradients(embeddings.limit(40), layer=layer, eps=1e-4)
        worst = rows.agg(F.max("difference"), F.count("*")).first()
        assert worst[0] < 1e-6
        n, k = ((64, 6), (6, 3))[layer - 1]
        assert worst[1] == (n + 1) * k + (0 if decoder == "tied" else (k + 1) * n)


@pytest.mark.parametrize("activation", ["tanh", "relu", "lrelu", "elu"])
def test_other_activations(embeddings, activation):
    df = embeddings.limit(40)
    model = fit(df, method="regular", hidden=[5], activation=activation, learning=0.05, epochs=6)
    losses = [r.loss for r in model.history.orderBy("epoch").collect()]
    assert losses[-1] < losses[0]
    rows = model.check_gradients(df, eps=1e-6)
    differences = sorted(r.difference for r in rows.collect())
    # relu has kinks: a nudged weight may cross one for a row, so a few entries may be off.
    assert differences[int(len(differences) * 0.95)] < 1e-5


@pytest.mark.parametrize("scaling", [True, False])
def test_saved_models_encode_alike(spark, embeddings, tmp_path, scaling):
    df = embeddings
    if not scaling:
        df = df.withColumn("embedding", F.transform("embedding", lambda v: (v + 1) / 2))
    model = fit(df, method="denoising", scaling=scaling)
    path = str(tmp_path / "model")
    model.save(path)
    again = StackedAutoencoderModel.load(path)
    a = model.encode(df).orderBy("vec_id").select("code").collect()
    b = again.encode(df).orderBy("vec_id").select("code").collect()
    assert a == b
    assert again.history.count() == 6 and again.getOrDefault("hidden") == [6, 3]
    model.write().overwrite().save(path)


def test_text_layout(spark, embeddings, tmp_path):
    model = fit(embeddings, method="regular", epochs=1)
    path = model.export_text(str(tmp_path), "emb")
    assert path.endswith("/emb[6,3]AE.csv")
    literal = path.replace("[", "\\[").replace("]", "\\]")
    lines = [r.value for r in spark.read.text(literal).collect()]
    assert lines[0] == "64_6_3_UnsupervisedAE"
    assert len(lines) == 1 + 65 * 6 + 7 * 3
    flat = np.concatenate([w.ravel() for w in model.weights])
    np.testing.assert_array_equal([float(v) for v in lines[1:]], flat)
    for a, b in zip(import_text(spark, path), model.weights):
        np.testing.assert_array_equal(a, b)


def test_long_weights_assemble_again(embeddings):
    model = fit(embeddings, method="regular", epochs=1)
    table = model.weights_df()
    again = assemble_weights(flatten_weights(table))
    key = ["layer", "role", "first_row"]
    assert again.orderBy(key).collect() == table.orderBy(key).collect()


@pytest.mark.parametrize("cells", [1, 7, 100])
def test_models_in_many_blocks(spark, embeddings, cells):
    model = fit(embeddings, method="regular", epochs=1)
    table = model_table(spark, model.weights, model.decoders, cells)
    assert table.count() > 4
    assert table.where(f"size(weights) > greatest({cells}, n_out)").count() == 0
    for role, matrices in (("encoder", model.weights), ("decoder", model.decoders)):
        for a, b in zip(matrices_of(table, role), matrices):
            np.testing.assert_array_equal(a, b)
    long = flatten_weights(table)
    again = assemble_weights(long, cells)
    key = ["layer", "role", "first_row"]
    assert again.orderBy(key).collect() == table.orderBy(key).collect()
    places = long.where("role = 'encoder' AND layer = 1").orderBy("pos").select("w").collect()
    np.testing.assert_array_equal([r.w for r in places], model.weights[0].ravel())


def test_edges_of_columns_agree_with_blocks(spark):
    z = np.array([-np.inf, -800.0, -1.0, -0.0, 0.0, 2.0, 800.0, np.inf, np.nan])
    df = spark.createDataFrame([(float(v),) for v in z], "z double")
    for name, (f, df_) in fn.ACTIVATIONS.items():
        got = df.select(f("z").alias("f"), df_("z").alias("d")).toPandas()
        h = blocks.activate(z.copy(), name)
        np.testing.assert_allclose(got.f, h, atol=1e-15)
        np.testing.assert_allclose(got.d, blocks.slope(z, h, name), atol=1e-15)
        null = df.select(f(F.lit(None).cast("double")), df_(F.lit(None).cast("double"))).first()
        assert tuple(null) == (None, None)
    row = df.select(
        fn.clamp_probability(F.lit(float("nan"))), fn.clamp_probability(F.lit(None).cast("double")),
        fn.cross_entropy(F.array(F.lit(1.0)), F.array(F.lit(None).cast("double"))),
    ).first()
    assert np.isnan(row[0]) and row[1] is None and row[2] is None


def test_dead_and_saturated_units(spark):
    p = np.array([0.0, 1.0, 0.05, 0.5])
    df = spark.createDataFrame([(float(v),) for v in p], "p double")
    for guard in (True, False):
        rows = df.select(fn.kl_term("p", 0.05, guard), fn.kl_gradient("p", 0.05, 0.5, guard)).collect()
        total, pull = sparsity(p * 10, 10, 0.05, 0.5, 1, guard)
        np.testing.assert_allclose([r[1] for r in rows], pull)
        assert np.isfinite(total) == guard
        if guard:
            np.testing.assert_allclose(sum(r[0] for r in rows), total)


def test_training_with_a_dead_unit_stays_finite(spark, embeddings):
    model = fit(embeddings, method="sparse", epochs=3, beta=0.1, hidden=[3])
    assert all(np.isfinite(w).all() for w in model.weights)
    w = model.weights[0].copy()
    w[:, 0], w[0, 0] = 0.0, -900.0
    dead = model_from_weights(
        spark, [w], [model.decoders[0]], model.ranges, method="sparse", **SOURCE,
    )
    assert all(np.isfinite(r.kl) for r in dead.sparsity_terms(embeddings).collect())
    assert all(np.isfinite(r.g) for r in dead.gradients(embeddings).collect())


def test_null_vectors_and_widths_in_corrupt(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id long, x array<double>")
    assert [r.corrupted for r in corrupt(df, "x", ["id"]).collect()] == [None, None]
    some = spark.createDataFrame([(1, None), (2, [1.0, 2.0])], "id long, x array<double>")
    assert len(corrupt(some, "x", ["id"], width=2).where("id = 2").first().corrupted) == 2
    with pytest.raises(Exception, match="must have 3 features"):
        corrupt(some, "x", ["id"], width=3).collect()


def test_model_bound_is_an_option(embeddings):
    with pytest.raises(ValueError, match="modelBytes"):
        fit(embeddings, method="regular", epochs=1, modelBytes=1000)


def test_progress_is_logged(embeddings, caplog):
    with caplog.at_level("INFO", logger="layerstack.training"):
        fit(embeddings, method="regular", epochs=2)
    assert sum("epoch" in r.message for r in caplog.records) == 4


def test_estimator_params_roundtrip(tmp_path):
    a = StackedAutoencoder(hidden=[3], method="sparse", beta=0.2)
    a.save(str(tmp_path / "estimator"))
    b = StackedAutoencoder.load(str(tmp_path / "estimator"))
    assert b.getOrDefault("hidden") == [3] and b.getOrDefault("beta") == 0.2
    assert b.getOrDefault("epochs") == 15


def test_wide_layers_travel_as_broadcasts(spark):
    """Weights above a megabyte, and partial sums that take the shuffle."""
    df = spark.range(0, 600, 1, 4).select(
        F.array(*[F.abs(F.sin(F.col("id") * (i + 1))) for i in range(400)]).alias("features")
    )
    settings = Settings("features", [], [200], method="regular", epochs=2, scaling=False)
    direct, a = train(df, settings)
    tree, b = train(df, replace(settings, collect_bytes=3 << 20, reduce_bytes=1 << 20))
    np.testing.assert_allclose(direct.weights[0], tree.weights[0], atol=1e-12)
    np.testing.assert_allclose([r.loss for r in a], [r.loss for r in b], rtol=1e-12)
    model = model_from_weights(spark, direct.weights, direct.decoders, method="regular")
    loss = model.score(df).agg(F.avg("loss")).first()[0]
    assert loss < a[0].loss


def test_pipeline(embeddings, tmp_path):
    stack = StackedAutoencoder(method="regular", hidden=[3], epochs=1, **SOURCE)
    fitted = Pipeline(stages=[stack]).fit(embeddings)
    fitted.save(str(tmp_path / "pipeline"))
    again = PipelineModel.load(str(tmp_path / "pipeline"))
    a, b = (m.transform(embeddings).orderBy("vec_id").select("code") for m in (fitted, again))
    assert a.collect() == b.collect()


@pytest.mark.parametrize("method", ["regular", "sparse"])
def test_gradients_in_rounds_of_sums(embeddings, monkeypatch, method):
    """Unit vectors too many for one reducing group are added up in a tree: eight by twos."""
    df = embeddings.repartition(8)
    model = fit(df, method=method, epochs=1)
    key = ["role", "i", "j"]
    once = model.gradients(df).orderBy(key).collect()
    monkeypatch.setattr("layerstack.operators.gradients.REDUCE_BYTES", 1000)
    twice = model.gradients(df)
    one_round = plan_text(model.mean_activation(df)).count("Exchange")
    assert plan_text(twice).count("Exchange") == one_round + 2
    rows = twice.orderBy(key).collect()
    assert [r[:3] for r in rows] == [r[:3] for r in once]
    np.testing.assert_allclose([r.g for r in rows], [r.g for r in once], atol=1e-10)
    assert {r.m for r in rows} == {embeddings.count()}


def plan_text(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain()
    return text.getvalue()


def test_store_writes_whatever_the_size(spark, embeddings, tmp_path):
    """With a checkpoint folder no table is only cached, and a table that is dealt anew is written
    before the files it came from go."""
    settings = Settings("embedding", [], [4], method="regular")
    store = BlockStore(spark, settings, str(tmp_path))
    written = store.put(pack(embeddings, "embedding", []))
    assert not written.is_cached
    rows = embeddings.count()
    assert store.balance(written, rows, rows, 64) is written
    dealt = store.balance(written, 1 << 20, rows, 64)
    assert not dealt.is_cached and dealt.agg(F.sum("rows")).first()[0] == rows
    (folder,) = tmp_path.iterdir()
    assert len(list(folder.iterdir())) == 1
    store.close()
    assert not list(tmp_path.iterdir())
    with pytest.raises(ValueError, match="checkpoint folder"):
        BlockStore(spark, replace(settings, storage="table"), None)


@pytest.mark.parametrize("storage", ["auto", "table", "cache", "source"])
def test_training_leaves_nothing_behind(spark, embeddings, storage):
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.iterdir())
    fit(embeddings, method="regular", storage=storage)
    assert set(folder.iterdir()) == before


@pytest.mark.parametrize("method", METHODS)
def test_source_storage_scans_only_what_it_needs(spark, embeddings, method):
    stored, scanned = (fit(embeddings, method=method, storage=s) for s in ("table", "source"))
    for a, b in zip(stored.weights, scanned.weights):
        np.testing.assert_allclose(a, b, atol=1e-9)
    source = vector_source(embeddings, "embedding", 64, None, ["vec_id"])
    text = plan_text(source.df)
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in text
