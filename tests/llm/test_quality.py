"""The classifier: features and gradients by brute force, edge cases, held-out accuracy."""

import zlib

import numpy as np
import pytest

from layerstack.llm import quality as q

GOOD = "The cat sat on the mat, and it was warm.\nA second line says something else again."
BAD = "BUY!! NOW!! CHEAP!! DEALS!! " * 8


def test_features_match_plain_counts():
    line = b"Aa bb bb, C9!\n"
    row = q.passage_features(line)[0]
    for b in set(line):
        k = q.CLASS[b]
        share = sum(q.CLASS[c] == k for c in line) / len(line)
        assert row[k] == pytest.approx(share)
    plain = q.N_CLASSES
    assert row[plain + 2] == pytest.approx(4 / 4)  # Aa, bb, "bb,", C9! all differ
    assert row[plain + 3] == pytest.approx(2 / 4)
    again = q.passage_features(b"x x x y\n")[0]
    assert again[plain] == pytest.approx(2 / 4) and again[plain + 2] == pytest.approx(2 / 4)


def test_long_texts_are_cut_not_dropped(monkeypatch):
    text = "\n".join(f"line {i} of many words" for i in range(3000))
    whole = q.encode_text(text)
    monkeypatch.setattr(q, "SLICE", 1000)
    assert np.array_equal(whole, q.encode_text(text))
    assert len(q.encode_text("x" * 4001)) >= 11
    for blank in (None, "", "  \n\n "):
        assert q.encode_text(blank).tolist() == [[0.0] * q.N_FEATURES]


def test_gradients():
    rng = np.random.default_rng(3)
    x, starts, y = rng.normal(size=(7, q.N_FEATURES)), np.array([0, 3, 4]), np.array([1.0, 0, 1])
    shapes = {"W": (q.N_FEATURES, 4), "b": (4,), "V": (4, 3), "U": (4, 3), "w": (3,), "u": (4,), "c": ()}
    p = {k: rng.normal(size=v) for k, v in shapes.items()}

    def loss(p):
        s = 1 / (1 + np.exp(-q._forward(x, starts, p)["logit"]))
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    grads = q._gradients(x, starts, y, p)
    for k, v in p.items():
        for at in ([()] if v.shape == () else [tuple(rng.integers(0, n) for n in v.shape) for _ in range(5)]):
            up, down = {**p, k: np.array(v)}, {**p, k: np.array(v)}
            up[k][at] += 1e-6
            down[k][at] -= 1e-6
            assert np.asarray(grads[k])[at] == pytest.approx((loss(up) - loss(down)) / 2e-6, abs=1e-6)


def test_attention_finds_the_bad_passage():
    bags = [q.encode_text(GOOD)] * 20 + [q.encode_text(GOOD + "\n" + BAD)] * 20
    model = q.fit_bags(bags, np.array([1.0] * 20 + [0.0] * 20))
    scores = model.score([bags[0], bags[-1]])
    assert scores[0] > 0.9 and scores[1] < 0.1
    assert model.attention(bags[-1]).sum() == pytest.approx(1)


def test_operators(spark):
    rows = [(i, GOOD, 5) for i in range(30)] + [(i, BAD, 5) for i in range(30, 60)]
    odd = [(None, GOOD, 1), (70, None, 1), (70, None, 1), (71, "", 1), (72, "x" * 50_000, 1)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, Score int")
    labels = [(i, int(i < 30)) for i in range(60)] + [(None, 1), (5, None), (999, 0)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    model = q.fit(docs, labels)
    out = q.score(docs, model)
    assert out.columns == ["doc_id", "text", "score", "predicted"]
    got = out.collect()
    assert len(got) == 65 and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == int(r.doc_id < 30) for r in got if r.doc_id is not None and r.doc_id < 60)
    kept = q.keep_good(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= set(range(30))
    assert not {r.doc_id for r in kept.collect()} & set(range(30, 60))
    same = q.fit(docs.repartition(3), labels)
    assert same.score([q.encode_text(GOOD)]) == model.score([q.encode_text(GOOD)])
    assert q.score(docs.limit(0), model).count() == 0


def test_fold_of_null_ids(spark):
    """A null id counts as the empty text, so it is in a fold."""
    df = spark.createDataFrame([(None,), (7,), (1234,)], "doc_id long")
    got = [r[0] for r in df.select(q.fold(df.doc_id, 5)).collect()]
    assert got == [0, zlib.crc32(b"7") % 5, zlib.crc32(b"1234") % 5]


def test_sample_is_bounded_in_bytes(spark, monkeypatch):
    fitted = []
    monkeypatch.setattr(q, "fit_bags", lambda bags, labels: fitted.append(bags))
    docs = spark.createDataFrame([(i, GOOD * (1 + i % 3)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    q.fit(docs, labels)
    sizes = [b.nbytes for b in fitted[0]]
    assert len(sizes) == 40
    for limit in (0, sum(sizes) // 2, sum(sizes)):
        q.fit(docs, labels, sample_bytes=limit)
        held = sum(b.nbytes for b in fitted[-1])
        assert held <= limit and held > limit - 2 * max(sizes)
    q.fit(docs, labels, sample=5)
    assert len(fitted[-1]) == 5


def test_one_class_and_no_labels(spark):
    docs = spark.createDataFrame([(1, GOOD)], "doc_id long, text string")
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert q.score(docs, q.fit(docs, one)).first().score == 1.0
    assert q.score(docs, q.fit(docs, one.limit(0))).first().score == 0.5


def test_query_on_held_out_labels(spark, llm):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in llm["op10_quality"](spark, sf).collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    right = seen = 0
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        out = rows[r.doc_id]
        assert out.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert out.predicted == int(out.score >= 0.3)
        if out.held_out:
            seen += 1
            right += out.predicted == r.quality
    assert right / seen > 0.95
