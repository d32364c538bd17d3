"""Each stage of the pipeline against a plain rule on its own input."""

import re
from collections import Counter

import corpus_pipeline
import pytest
from test_bpe import THEIRS
from test_curriculum import water
from test_ngram_join import plain

from layerstack.llm import quality
from layerstack.llm.common import stored


@pytest.fixture(scope="module")
def states(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, out = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"test-{name}")
        out.append(docs)
    assert all(d.columns == columns for d in out[:-1])
    return [d.collect() for d in out]


def test_quality(spark, sf_dir, states):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before, after = states[0], {r.doc_id for r in states[1]}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0"))
    want = {r.doc_id for r in before if model.score([quality.encode_text(r.text)])[0] >= 0.3}
    assert after == want and 0 < len(after) < len(before)
    right = [labels[r.doc_id] == (r.doc_id in after) for r in before if r.doc_id in labels]
    assert sum(right) / len(right) > 0.95


def test_near_duplicates(states):
    rows = [(r.doc_id, r.text) for r in states[1]]
    assert sorted(r.doc_id for r in states[2]) == sorted({c for _, _, c in plain(rows)})
    texts = {r.doc_id: r for r in states[1]}
    assert all(r == texts[r.doc_id] for r in states[2])


def test_pii(states):
    personal = re.compile(r"(?<=password=)\w+|[\w.+-]+@[\w-]+\.[\w.]+|AKIA\w{16}|\b[0-9a-f]{40}\b|\b\d{16}\b|\+1 \(\d+\) \d+-\d+|\d+\.\d+\.\d+\.\d+")
    after = {r.doc_id: r for r in states[3]}
    assert len(after) == len(states[2])
    for r in states[2]:
        found = personal.findall(r.text)
        assert (after[r.doc_id].text == r.text) == (not found)
        assert not any(f in after[r.doc_id].text for f in found)
        assert after[r.doc_id].n_chars == len(after[r.doc_id].text)


def test_mixing(states):
    sizes, taken, times = Counter(), Counter(), Counter()
    texts = {r.doc_id: r.text for r in states[3]}
    for r in states[3]:
        sizes[r.source] += len(r.text.split())
    for r in states[4]:
        taken[r.source] += len(r.text.split())
        times[r.doc_id] += 1
        assert texts[r.doc_id].startswith(r.text)
    for source, target in water(dict(sizes)).items():
        assert abs(taken[source] - target) <= 1
    assert max(times.values()) <= 3


def test_tokens(states):
    texts = Counter((r.doc_id, tuple(THEIRS.encode(r.text).ids)) for r in states[4])
    assert Counter((r.doc_id, tuple(r.tokens)) for r in states[5]) == texts
    assert all(r.round_trip and r.n_tokens == len(r.tokens) for r in states[5])


def test_run(spark, sf_dir, states):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    key = lambda r: (r.doc_id, r.n_chars, tuple(r.tokens))
    assert sorted(map(key, rows)) == sorted(map(key, states[5]))


def test_empty(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
