"""Buckets follow the data, and packs that change are found out."""

import numpy as np
import pytest

from layerstack.llm import packs


def test_buckets_follow_the_data():
    assert packs.bucket_count(0, 8) == 16 and packs.bucket_count(1 << 62, 8) == 16
    assert packs.bucket_count(10 << 30, 8) == 1024
    assert packs.bucket_count(100 << 40, 200) == packs.MOST_BUCKETS
    sizes = [packs.bucket_count(1 << k, 12) for k in range(62)]
    assert all(n & (n - 1) == 0 and n >= 24 for n in sizes)


def test_digest():
    rng = np.random.default_rng(1)
    h = np.unique(rng.integers(0, 1 << 63, 1000, np.uint64))
    parts = sum(packs.digest_of(p) for p in np.split(h, [3, 500])) % (1 << 64)
    assert parts == packs.digest_of(h) % (1 << 64)
    other = h.copy()
    other[7] += np.uint64(1)
    assert packs.digest_of(other) != packs.digest_of(h)
    assert packs.digest_of(np.empty(0, np.uint64)) == 0
    found = packs.Answers(np.zeros(len(h), np.uint8), packs.digest_of(h))
    assert len(found.to(h)) == len(h)
    for wrong in (other, h[1:]):
        with pytest.raises(RuntimeError):
            found.to(wrong)


def test_input_sizes_are_known(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = packs.pack(docs)._jdf.queryExecution().optimizedPlan()
    (leaf,) = packs._leaves(plan)
    assert 0 < int(str(leaf.stats().sizeInBytes())) < 1 << 40
