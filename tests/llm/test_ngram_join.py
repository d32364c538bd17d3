"""Components against all pairs of shingle sets."""

import random

import numpy as np
import pytest

from layerstack.llm import links, ngram_join, packs


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def plain(rows):
    """All pairs; a component's id is its smallest id."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b) and root[i] != root[j]:
                old = root[i]
                root = [root[j] if r == old else r for r in root]
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [d for k, (d, _) in enumerate(rows) if root[k] == root[i] and d is not None]
        out.append((doc, len(sets[i]), min(ids, default=None) if sets[i] else doc))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def corpus(seed, n=150):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    common = " ".join(rng.choices(words, k=25))
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.45:  # a copy with some words changed
            w = rng.choice(texts).split()
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w))
        elif kind < 0.6:
            texts.append(common + " " + " ".join(rng.choices(words, k=rng.randrange(12))))
        else:
            texts.append(" ".join(rng.choices(words, k=rng.choice([1, 3, 6, 40, 80]))))
    rows = [(i * 2, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("block", [2000, 3])
def test_components(spark, monkeypatch, seed, block):
    monkeypatch.setattr(packs, "PACK_DOCS", 20)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block)
    rows = corpus(seed) + [(None, "no id but five words"), (9999, "No Id but\tfive words"), (None, None), (10000, ""), (7, " ")]
    rows += [(None, "only null ids here today"), (10001, "a b"), (10002, "A B"), (10001, "a b"), (10003, "b a")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, root int")
    got = ngram_join.join_components(df.repartition(3))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert result(got) == plain(rows)


def test_threshold_is_exact():
    for n in range(1, 60):
        for m in range(1, 60):
            for o in range(min(n, m) + 1):
                exact = 100 * o >= 80 * (n + m - o)
                assert ngram_join.similar(o, n, m) == exact
                if exact:
                    assert o >= ngram_join.needed(n) and 9 * o >= 4 * (n + m)


def test_spanning_links_equal_all_pairs():
    rng = np.random.default_rng(4)
    for _ in range(30):
        base = rng.integers(0, 400, (6, 30))
        sets = []
        for _ in range(60):
            s = base[rng.integers(6)].copy()
            s[rng.integers(0, 30, rng.integers(0, 6))] = rng.integers(0, 400)
            sets.append(np.unique(s).astype(np.uint64))
        sides = rng.integers(0, 2, 60).tolist() if rng.random() < 0.5 else [0] * 60
        def span(pairs):
            root = list(range(60))
            for a, b in pairs:
                root = [root[a] if r == root[b] else r for r in root]
            return {frozenset(i for i in range(60) if root[i] == r) for r in set(root)}
        every = [
            (i, j) for i in range(60) for j in range(i)
            if (len(set(sides)) == 1 or sides[i] != sides[j])
            and ngram_join.similar(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))
        ]
        found = ngram_join.spanning_links(sets, sides)
        assert span(found) == span(every) and len(found) < 60
        given = every[::2]
        known = [min(g) for i in range(60) for g in span(given) if i in g]
        rest = ngram_join.spanning_links(sets, sides, known)
        assert span(rest + given) == span(every) and len(rest) < 60


def test_copies_are_linked_one_by_one(spark, monkeypatch):
    """A large group of near copies needs no pairs of blocks; others are still found by them."""
    rng = random.Random(3)
    base = rng.choices([f"w{i}" for i in range(1000)], k=150)
    texts = []
    for i in range(40):
        w = list(base)
        w[rng.randrange(150)] = f"x{i}"
        texts.append(" ".join(w))
    chain = [" ".join(base[:5 * k] + [f"y{j}" for j in range(5 * k, 150)]) for k in range(31)]
    rows = list(enumerate(texts + chain))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 8)
    sets = ngram_join.stored(ngram_join.ordered_sets(df.limit(40)), "test-sets")
    classes = sets.where("shingles IS NOT NULL").selectExpr("doc_id AS cls", "key", "n", "prefix", "shingles")
    first = ngram_join.first_links(classes).collect()
    assert len(first) == 39 and len({r.a for r in first}) == 39
    assert result(ngram_join.join_components(df)) == plain(rows)


def test_components_of_links(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)]
    edges += [(5, 5), (None, 3), (3, None), (7, 8)]
    got = {r.node: r.root for r in links.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e if None not in e and e[0] != e[1]}
    for _ in range(200):
        for a, b in edges:
            if a in root and b in root and a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_keep_one(spark):
    rows = corpus(9, 60) + [(None, "no id but five words"), (9999, "No Id but\tfive words"), (None, None), (None, None)]
    rows += [(10000, ""), (7, "five words or more here"), (7, "five words or more here"), (7, "another text of that id")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, _id string")
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    want = []
    for r in set(root):
        members = [row for k, row in enumerate(rows) if root[k] == r]
        want.append(min((d for d, _ in members if d is not None), default=None))
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(map(repr, want))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.join_components(df).count() == 0
    assert ngram_join.keep_one(df).count() == 0


def test_query(spark, llm):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert result(llm["op7_ngram_join"](spark, sf)) == plain(rows)
