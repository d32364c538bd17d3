"""The curve against its definition, results against brute force."""

import itertools
import random

import numpy as np
import pytest

from layerstack.llm import hilbert_ann as ann


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (4, 2)])
def test_curve_visits_neighbours(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = ann.hilbert_index(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def compare(spark, rows, k=10, **options):
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in ann.nearest(df.repartition(3), lambda i: i % 10 == 0, k, **options).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(v) for q, v in got.items()}


def test_whole_windows_are_exact(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 16)
    monkeypatch.setattr(ann, "CELLS", 40)
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(120)]
    rows += [(i, rows[7][1]) for i in range(120, 160)]  # many equal vectors
    rows += [(200, None), (210, [0.0] * 6), (220, [1.0] * 5), (230, [float("nan")] + [1.0] * 5), (240, [1.0, None] * 3)]
    rows += [(None, [1.0] * 6), rows[10], (250, [float("inf")] + [1.0] * 5)]
    kept = {i: v for i, v in rows if i is not None and i < 200}
    got = compare(spark, rows, share=1.0)
    assert got.keys() == {i for i in kept if i % 10 == 0}
    for q, found in got.items():
        want = ann.brute_force(kept, q)
        assert [(r, v) for r, v, _ in found] == [(r, v) for r, (v, _) in enumerate(want, 1)]
        assert [s for *_, s in found] == pytest.approx([s for _, s in want], rel=1e-14)


def test_queries_stream_past_blocks(spark):
    """Every row a query, in batches much smaller than a block's queries."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {}
        for r in ann.nearest(df, lambda i: i >= 0, 3, share=1.0).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 400
    for q, found in got.items():
        assert [v for _, v in sorted(found)] == [v for v, _ in ann.brute_force(dict(rows), q, 3)]


def test_few_rows(spark):
    assert compare(spark, [(0, [1.0, 2.0])]) == {}
    got = compare(spark, [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, 4.0])])
    assert [v for _, v, _ in got[0]] == [1, 2]
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(empty, lambda i: i % 10 == 0).count() == 0


def test_clusters_need_narrow_windows(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 32)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 8)) * 5
    rows = [(i, (centres[i % 60] + rng.normal(size=8) * 0.1).tolist()) for i in range(1800)]
    got, vectors = compare(spark, rows, share=0.1), dict(rows)
    hits = [len({v for _, v, _ in got[q]} & {v for v, _ in ann.brute_force(vectors, q)}) for q in got]
    assert len(got) == 180 and np.mean(hits) > 9


def test_query_recall(spark, llm):
    sf = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    vectors = {r.vec_id: r.embedding for r in table.collect()}
    rows = {}
    for r in llm["op5_hilbert_ann"](spark, sf).collect():
        rows.setdefault(r["query_id"], []).append(r)
    assert rows.keys() == {i for i in vectors if i % 100 == 0}
    hits = 0
    for q, found in rows.items():
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 11))
        want = dict(ann.brute_force(vectors, q, len(vectors)))
        for r in found:
            assert r["score"] == pytest.approx(want[r["vec_id"]], rel=1e-14)
        hits += len({r["vec_id"] for r in found} & {v for v, _ in ann.brute_force(vectors, q)})
    assert hits / len(rows) / 10 >= 0.9
