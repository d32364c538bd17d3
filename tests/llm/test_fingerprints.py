"""Fingerprints against generalised Jaccard similarity, and neighbours against a sorted list."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from layerstack.llm import fingerprints as fp


def jaccard(a, b):
    def terms(t):
        w = t.lower().split()
        return Counter(zip(w, w[1:])) if len(w) > 1 else Counter(w)

    x, y = terms(a), terms(b)
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def test_collisions_follow_similarity():
    rng, s = random.Random(5), fp.sampler()
    errors = []
    for _ in range(150):
        vocab = [f"w{i}" for i in range(rng.choice([4, 30, 3000]))]
        a = [rng.choice(vocab) for _ in range(rng.choice([30, 300, 9000]))]
        b = a[: rng.randrange(len(a))] + [rng.choice(vocab) for _ in range(rng.randrange(200))]
        a, b = " ".join(a), " ".join(b)
        errors.append(fp.likeness(s.sample(a), s.sample(b)) - jaccard(a, b))
    assert abs(np.mean(errors)) < 0.012 and np.std(errors) < 0.05 and max(map(abs, errors)) < 0.18


def test_edges():
    s = fp.sampler()
    hexes = {t: fp.to_hex(s.sample(t)) for t in ("", " \n", "one", "One", "one two", "x" * 5000)}
    assert hexes[""] == hexes[" \n"] and hexes["one"] == hexes["One"] and len(hexes[""]) == 512
    assert fp.likeness(s.sample(""), s.sample("one")) < 0.05
    long = "ab" * 40_000
    assert fp.likeness(s.sample(long), s.sample(long + "c")) > 0.6
    assert fp.half_replaced("abcde", "xyz") == "abcxy" and fp.half_replaced("abcdef", "x") == "abcx"
    assert fp.half_replaced("", "x") == ""


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    texts = [r[1] or "" for r in rows]
    for i, (doc_id, _) in enumerate(rows):
        following = texts[(i + 1) % len(rows)]
        half = len(texts[i]) // 2
        edited = texts[i][: len(texts[i]) - half] + following[:half]
        yield doc_id, texts[i], edited, following


@pytest.mark.parametrize("parts", ["1", "3", "40"])
def test_neighbours(spark, parts):
    rng = random.Random(1)
    rows = [(rng.randrange(90), " ".join(rng.choice("abcdefgé") * 3 for _ in range(rng.randrange(30)))) for _ in range(60)]
    rows += [(None, "no id"), (None, None), (3, None), (2**60, "large"), (-5, "x"), (7, "t"), (7, "t")]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, fingerprint string")
        got = fp.compare_with_next(df.repartition(4)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    s = fp.sampler()
    want = [
        (i, len(t), hashlib.sha256(e.encode()).hexdigest(), fp.to_hex(s.sample(t)), fp.to_hex(s.sample(e)),
         fp.likeness(s.sample(t), s.sample(e)), fp.likeness(s.sample(t), s.sample(n)))
        for i, t, e, n in expected(rows)
    ]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_small_tables(spark):
    schema = "doc_id long, text string"
    assert fp.compare_with_next(spark.createDataFrame([], schema)).count() == 0
    (only,) = fp.compare_with_next(spark.createDataFrame([(4, "a b c d")], schema)).collect()
    assert only.near_next == 1.0 and only.n_chars == 7


def test_columns(spark):
    df = spark.createDataFrame([("a b c", 1), (None, 2)], "text string, Fingerprint int")
    out = fp.fingerprint(df)
    assert out.columns == ["text", "fingerprint"]
    a = out.select(fp.similarity(F.col("fingerprint"), F.col("fingerprint")).alias("s"))
    assert [r.s for r in a.collect()] == [1.0, 1.0]


def test_query(spark, llm):
    sf = "/root/testdata/sf0.01"
    rows = llm["op3_fingerprints"](spark, sf).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {i: (t, e, n) for i, t, e, n in expected(docs)}
    assert len(rows) == len(docs)
    for r in rows:
        t, e, n = want[r.doc_id]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert abs(r.near_edited - jaccard(t, e)) < 0.22 and abs(r.near_next - jaccard(t, n)) < 0.22
    assert sum(r.near_edited > r.near_next for r in rows) > 0.97 * len(rows)
