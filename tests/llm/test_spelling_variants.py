"""Variants against all pairs on small vocabularies, and against deletions on a whole table."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from layerstack.llm import spelling_variants as sv

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def counted(rows, spoil=97, min_length=5, min_count=3):
    out = Counter()
    for i, t in rows:
        for run in LETTERS.findall(t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if spoil and h % spoil == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= min_length and n >= min_count}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def neighbours(words):
    """Near words of each: those that share a word with one character deleted, or are one; then all checked."""
    deleted = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            deleted[w[:i] + w[i + 1 :]].add(w)
    out = defaultdict(set)
    for shorter, longer in deleted.items():
        group = longer | ({shorter} if shorter in words else set())
        for a in group:
            out[a].update(b for b in group if a != b and one_edit(a, b))
    return out


def plain(words, ratio=2, near=None):
    near = neighbours(words) if near is None else near
    forms = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best is not None and words[best] >= ratio * n else None
    out = {}
    for w, n in words.items():
        root = w
        while forms[root]:
            root = forms[root]
        form = forms[w]
        out[w] = (form, root, n, len(near[w]), words[form] if form else None)
    return out


def result(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    out = {r[0]: r[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def vocabulary(seed, n=400):
    rng = random.Random(seed)
    words = {"".join(rng.choices("abcdeéÿ", k=rng.randrange(1, 8))) for _ in range(n)}
    for w in list(words)[: n // 3]:
        i = rng.randrange(len(w) + 1)
        words.add(rng.choice([w[:i] + rng.choice("abqü") + w[i:], w[:i] + w[i + 1 :] or "a", w[:i] + "z" + w[i + 1 :]]))
    words |= {"m" * 300, "m" * 301, "m" * 150 + "n" + "m" * 149, "p" * 70000, "p" * 69999}
    return {w: rng.choice([3, 4, 6, 8, 16, 16, 64, 1000]) for w in words}


@pytest.mark.parametrize("seed,node_words", [(1, 20_000), (2, 30), (3, 2)])
def test_against_all_pairs(spark, seed, node_words):
    words = vocabulary(seed)
    near = {w: {x for x in words if abs(len(w) - len(x)) < 2 and x != w and one_edit(w, x)} for w in words if len(w) < 1000}
    near |= {"p" * 70000: {"p" * 69999}, "p" * 69999: {"p" * 70000}}
    assert {w: v for w, v in neighbours({w: n for w, n in words.items() if len(w) < 1000}).items() if v} == {
        w: v for w, v in near.items() if v and len(w) < 1000
    }
    df = spark.createDataFrame([(w, n, 1) for w, n in words.items()], "word string, n long, Length int")
    assert result(sv.group_variants(df.repartition(3), node_words=node_words)) == plain(words, near=near)


def test_long_chains(spark):
    base = "abcdefghijkl"
    words = {base[:i] + "x" * (len(base) - i): 3 * 2**i for i in range(len(base) + 1)}
    words |= {"tiess": 3, "tieas": 6, "tiebs": 6, "hotel": 6, "hotal": 4}
    got = result(sv.group_variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == plain(words)
    assert got["x" * 12][1] == base and got["tiess"][0] == "tieas" and got["hotal"][0] is None


def test_search_walks_deep(monkeypatch):
    """Leaves of one word, and few comparisons at once."""
    monkeypatch.setattr(sv, "LEAF_WORDS", 1)
    monkeypatch.setattr(sv, "CELLS", 64)
    words = [w for w in vocabulary(9) if len(w) in (4, 5)]
    homes = np.array([i for i, w in enumerate(words) if len(w) == 5])
    got = {(words[a], words[b]) for g, h in sv.search(words, homes, np.arange(len(words)), 0) for a, b in zip(g, h)}
    assert got == {(a, words[b]) for a in words for b in homes if one_edit(a, words[b])}


def test_visits_meet_once():
    """Each pair of near vectors is met from one side exactly."""
    for levels in (1, 2, 4):
        steps = sv.visits(levels)
        assert len(steps) == len(set(steps)) == 2 + 2 * levels + levels * (levels - 1) // 2
        mirrored = {(0, tuple(-x for x in s)) for length, s in steps if not length and any(s)}
        assert not mirrored & set(steps)


ROWS = [
    (1, "Hello hello HELLO hallo, Größe größe GRÖSSE größe"), (1, "hello " * 40), (None, "Hallo hallo ×abcd÷ naïve"),
    (2, None), (3, ""), (4, "ab " * 50), (5, "helloı héllo 12hello34 hello_hello"), (6, "Hallo " * 3),
    *[(i, "Naïve gröse grösse größe größe " * 2) for i in range(100, 400)],
]


@pytest.mark.parametrize("spoil", [None, 97, 3])
def test_counts(spark, monkeypatch, spoil):
    monkeypatch.setattr(sv, "TABLE_WORDS", 3)
    monkeypatch.setattr(sv, "LIST_BYTES", 100)
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "doc_id int, text string, N string").repartition(3)
    got = {r.word: r.n for r in sv.count_words(df, spoil=spoil).collect()}
    assert got == counted(ROWS, spoil)


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sv.group_variants(sv.count_words(empty)).count() == 0
    one = spark.createDataFrame([("alone", 3)], "word string, n long")
    assert result(sv.group_variants(one)) == {"alone": (None, "alone", 3, 0, None)}
    with pytest.raises(ValueError):
        sv.group_variants(one, ratio=1)


def test_query(spark, llm):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    df = llm["op13_spelling_variants"](spark, sf)
    assert df.dtypes == [
        ("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"),
        ("form_n", "bigint"),
    ]
    got, want = result(df), plain(counted(rows))
    assert got == want
    assert sum(v[0] is not None for v in got.values()) > 100
