"""Physical plans: what reaches the scan, and where data is shuffled."""

import contextlib
import io
import shutil

import pytest
from fixture_data import DATA
from pyspark.sql import functions as F

import __spark_entry__ as contract
from catalog.queries import EMBEDDING, start_model
from layerstack import StackedAutoencoder, feature_profile
from layerstack.operators.tables import block_source, pack
from layerstack.streaming import score_stream

COLUMNS = ["l_quantity", "l_tax"]


def plan(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


@pytest.fixture(scope="module")
def lineitem(spark):
    return spark.read.parquet(f"{DATA}/lineitem.parquet")


@pytest.fixture(scope="module")
def model(lineitem):
    return StackedAutoencoder(inputCols=COLUMNS, hidden=[2], method="regular", epochs=0).fit(lineitem)


def test_scoring_prunes_and_pushes_filters_below_python(model, lineitem):
    df = model.score(model.encode(lineitem)).where("l_orderkey < 100").select(
        "l_orderkey", "code", "loss"
    )
    text = plan(df)
    assert "LessThan(l_orderkey,100)" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_tax:double>" in text
    assert text.count("ArrowEvalPython (") == 1  # both columns in one trip to Python
    assert "Exchange" not in text


def test_unused_codes_are_not_computed(model, lineitem):
    text = plan(model.encode(lineitem).groupBy("l_returnflag").count())
    assert "ArrowEvalPython" not in text
    assert "ReadSchema: struct<l_returnflag:string>" in text


def test_aggregations_read_only_features_and_shuffle_partials_only(model, lineitem):
    plans = {
        "gradients": plan(model.gradients(lineitem)),
        "check": plan(model.check_gradients(lineitem)),
        "mean": plan(model.mean_activation(lineitem)),
        "profile": plan(feature_profile(lineitem, COLUMNS)),
    }
    for text in plans.values():
        assert "ReadSchema: struct<l_quantity:double,l_tax:double>" in text
        assert text.count("Exchange (") == 1 and "Join" not in text
    # The shuffle carries vectors, one per unit or chunk of features and task, not a row per number.
    for name in ("gradients", "check", "profile"):
        assert plans[name].count("MapInArrow (") == 3
        assert "hashpartitioning(chunk" in plans[name]
    assert plans["mean"].count("MapInArrow (") == 1 and "partial_" in plans["mean"]


def test_epochs_read_blocks_without_shuffle(embeddings):
    blocks = pack(embeddings, "embedding", ["vec_id"])
    text = plan(block_source(blocks, 64, "f4", None).narrowed(100))
    assert "Exchange" not in text
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in text


def test_stored_figures_are_read_without_values(spark, embeddings, tmp_path):
    path = str(tmp_path / "blocks")
    pack(embeddings, "embedding", []).write.parquet(path)
    text = plan(spark.read.parquet(path).select("rows", "lo", "hi"))
    assert "ReadSchema: struct<rows:int,lo:binary,hi:binary>" in text


def test_stream_resumes_with_new_files(spark, embeddings, tmp_path):
    model = StackedAutoencoder(
        featuresCol="embedding", hidden=[4], method="regular", epochs=0
    ).fit(embeddings)
    inbox, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))

    def run():
        stream = spark.readStream.schema(embeddings.schema).parquet(inbox)
        query = score_stream(model, stream, out, progress, ["vec_id"], available_now=True)
        query.awaitTermination()
        return spark.read.parquet(out)

    embeddings.where("vec_id % 2 = 0").write.mode("append").parquet(inbox)
    first = run().count()
    embeddings.where("vec_id % 2 = 1").write.mode("append").parquet(inbox)
    rows = run()
    assert 0 < first < rows.count() == embeddings.count()
    batch = model.score(model.encode(embeddings)).select("vec_id", "code", "loss")
    assert rows.select("vec_id", "code", "loss").exceptAll(batch).count() == 0
    assert rows.agg(F.countDistinct("vec_id")).first()[0] == embeddings.count()


@pytest.mark.parametrize("folder", [True, False])
def test_stream_of_a_table_in_one_file_or_many(spark, embeddings, tmp_path, folder):
    """A table may be a file or a folder of files; both are streamed whole."""
    path = tmp_path / "embeddings.parquet"
    if folder:
        embeddings.repartition(3).write.parquet(str(path))
    else:
        shutil.copy(f"{DATA}/embeddings.parquet", path)
    rows = contract.queries()["stream_encode"](spark, str(tmp_path)).collect()
    batch = start_model(embeddings, [8, 4], method="regular", **EMBEDDING).encode(embeddings)
    want = {(r.vec_id, i): round(v, 6) for r in batch.collect() for i, v in enumerate(r.code)}
    assert len(rows) == len(want) == 4 * embeddings.count()
    assert all(abs(r.a - want[r.vec_id, r.unit]) < 2e-6 for r in rows)
