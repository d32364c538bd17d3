"""Removed words against a brute-force index of all windows."""

import hashlib
import random

import numpy as np
import pytest

from layerstack.llm import packs
from layerstack.llm import substring_dedup as sd


def plain(rows, size=13):
    first = {}
    docs = [(-(1 << 63) if i is None else i, (t or "").encode().split()) for i, t in rows]
    for i, w in docs:
        for s in range(len(w) - size + 1):
            key = tuple(w[s : s + size])
            first[key] = min(first.get(key, i), i)
    out = []
    for (raw, _), (i, w) in zip(rows, docs):
        gone = set()
        for s in range(len(w) - size + 1):
            if first[tuple(w[s : s + size])] < i:
                gone.update(range(s, s + size))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((raw, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr)


@pytest.fixture
def small_packs(monkeypatch):
    monkeypatch.setattr(packs, "PACK_BYTES", 2000)
    monkeypatch.setattr(packs, "PACK_DOCS", 7)


@pytest.mark.parametrize("parts", [1, 5])
def test_random_documents(spark, small_packs, parts):
    rng = random.Random(parts)
    words = [f"w{i}" for i in range(200)]
    passages = [" ".join(rng.choices(words, k=rng.randrange(8, 40))) for _ in range(12)]
    rows = []
    for i in range(120):
        parts_of = [" ".join(rng.choices(words, k=rng.randrange(30))) for _ in range(3)]
        parts_of.insert(rng.randrange(3), rng.choice(passages))
        rows.append((i * 3 % 400, "\n".join(parts_of)))
    rows += [(1, "the same words " * 30), (1, "the same words " * 30), (2, "The same words " * 30), (2**50, "x y " * 40)]
    rows += [(None, passages[0]), (None, None), (500, ""), (501, " \n"), (502, " ".join(words * 30)), (503, " ".join(words * 30))]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, kept int").repartition(parts)
    assert result(sd.duplicate_spans(df)) == plain(rows)


def test_spans_and_text(spark):
    a = [f"a{i}" for i in range(20)]
    b = [f"b{i}" for i in range(20)]
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(["x", *a, *b, "y"])), (4, " ".join(a[:12]))]
    got = {r.doc_id: r for r in sd.duplicate_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s.start, s.end) for s in got[3].spans] == [(1, 41)] and got[3].kept == "x y"
    assert got[4].n_removed == 0 and got[1].kept == " ".join(a)


def test_parse():
    blocks = np.zeros(40, np.uint8)
    blocks[[2, 3, 9, 30]] = 7
    assert sd.factors(blocks, 5) == [(2, 8, 7), (9, 14, 7), (30, 35, 7)]
    blocks[4:6] = 9  # another block has what follows: a factor across the boundary
    assert sd.factors(blocks, 5) == [(2, 8, 7), (4, 10, 9), (9, 14, 7), (30, 35, 7)]
    assert sd.spans(sd.factors(blocks, 5)) == [(2, 14), (30, 35)]
    assert sd.factors(np.zeros(0, np.uint8), 5) == [] == sd.spans([])


def plain_factors(rows, size=13):
    """Windows one after another, each with the block of the first document that has it."""
    first, docs = {}, [(i, t.split()) for i, t in rows]
    for i, w in docs:
        for s in range(len(w) - size + 1):
            key = tuple(w[s : s + size])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in docs:
        found = []
        for s in range(len(w) - size + 1):
            source = first[tuple(w[s : s + size])]
            if source < i:
                block = int(sd.block_of(np.array([source]))[0])
                if found and found[-1][1] == s + size - 1 and found[-1][2] == block:
                    found[-1][1] += 1
                else:
                    found.append([s, s + size, block])
        out[i] = [tuple(f) for f in found]
    return out


def test_factors_name_their_block(spark, small_packs):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    passages = [rng.choices(words, k=30) for _ in range(6)]
    rows = []
    for i in range(90):
        body = rng.choices(words, k=10)
        for p in rng.sample(passages, rng.randrange(4)):
            cut = rng.randrange(15)
            body += p[cut:] + rng.choices(words, k=rng.choice([0, 0, 5]))
        rows.append((i, " ".join(body)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: [tuple(f) for f in r.factors] for r in sd.duplicate_spans(df).collect()}
    assert got == plain_factors(rows)
    assert len({f[2] for v in got.values() for f in v}) > 3
    assert all(end - start >= 13 for v in got.values() for start, end, _ in v)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert sd.duplicate_spans(df).count() == 0
    only = spark.createDataFrame([(1, None), (2, "a b")], "doc_id long, text string")
    assert result(sd.duplicate_spans(only)) == plain([(1, None), (2, "a b")])


def test_query(spark, llm):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert result(llm["op8_substring_dedup"](spark, sf)) == plain(rows)
