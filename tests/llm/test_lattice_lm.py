"""The lattice against all segmentations written out, and the query against a plain loop."""

import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from layerstack.llm import lattice_lm as lm

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def segmentations(word, pieces):
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        if word[:n] in pieces:
            for rest in segmentations(word[n:], pieces):
                yield [word[:n], *rest]


@pytest.mark.parametrize("word", [b"a", b"the", b"therein", "für".encode(), b"x1-zq", b"tion\xff"])
def test_forward_sums_all_segmentations(word):
    names, prior = lm.read_pieces(PATH)
    q = dict(zip(names, prior))
    log_q = np.log(prior).tolist()
    every = list(segmentations(word.decode("latin-1"), q))
    total = sum(math.prod(q[p] for p in s) for s in every)
    assert lm.forward(word, lm.automaton(PATH).iter, log_q)[-1] == pytest.approx(math.log(total))
    uses = Counter()
    for s in every:
        for p in s:
            uses[p] += math.prod(q[x] for x in s) / total
    got = [0.0] * len(names)
    used = lm.expected_counts(word, list(lm.automaton(PATH).iter(word.decode("latin-1"))), log_q, got)
    assert used == pytest.approx(sum(uses.values()))
    assert {names[i]: v for i, v in enumerate(got) if v} == pytest.approx(dict(uses))
    pieces, again = lm.Pieces(PATH, log_q), [0.0] * len(names)
    assert pieces.log_sum(word) == pytest.approx(math.log(total))
    assert pieces.add_expected(word, again) == pytest.approx(used)
    assert again == pytest.approx(got)


def test_long_words_do_not_underflow():
    _, prior = lm.read_pieces(PATH)
    value = lm.forward(b"zq" * 5000, lm.automaton(PATH).iter, np.log(prior).tolist())[-1]
    assert -200_000 < value < -10_000
    pieces = lm.Pieces(PATH, np.log(prior).tolist())
    for word in (b"zq" * 5000, b"\xfe" * 64, b"\x01" * 40):
        exact = lm.forward(word, lm.automaton(PATH).iter, pieces.log_q)[-1]
        assert pieces.log_sum(word) == pytest.approx(exact)
        counts = [0.0] * len(prior)
        assert pieces.add_expected(word, counts) == pytest.approx(sum(counts))


def plain(docs, model, training):
    """Scores of texts by the formulas, from counts made here."""
    words, lines = Counter(), Counter()
    for t in training:
        rows = lm.words_of(t)
        words.update(w for r in rows for w in r)
        lines.update(b" ".join(r) for r in rows if len(r) > 1)
    n = sum(words.values()) + len(training)
    v = len(words) + (1 if training else 0)
    n1, n2 = (sum(c == k for c in words.values()) for k in (1, 2))
    d = n1 / max(1, n1 + 2 * n2)
    again = sum(c for c in lines.values() if c > 1)
    units = again + n
    share = again / units if units else 0.0
    mass = sum(lines.values()) - 0.5 * len(lines)
    counts = dict(words)

    def p(w):
        c = counts.get(w, 0)
        return (max(c - d, 0) + (d * len(words) + 1) * 10 ** model.spell(w)) / (n + 1.5)

    for t in docs:
        rows = lm.words_of(t)
        flat = [w for r in rows for w in r]
        base = [counts.get(w, 0) for w in flat] + [len(training)]
        score = math.log10((1 - share) * (len(training) + 0.5) / (n + 1.5))
        for r in rows:
            x = math.prod(p(w) for w in r) * (1 - share) ** len(r)
            c = lines.get(b" ".join(r), 0)
            score += math.log10(x + (share * (c - 0.5) / mass if c else 0))
        yield (
            len(base), sum(c > 0 for c in base), n,
            sum(math.log10((c + 1) / (n + 1 * (v + 1))) for c in base), score,
        )


TEXTS = [
    "The cat sat\non the mat", "the cat sat\nunknownword here", "THE Cat sat", "", None, "  \n ", "solo",
    "É é x y", "the cat sat\n\nthe\tcat sat", "same text", "same text", "q" * 70 + " tail",
]


@pytest.mark.parametrize("head,hot", [(0, 1000), (3, 1), (1000, 1000), (1000, 3)])
def test_scores(spark, monkeypatch, head, hot):
    monkeypatch.setattr(lm, "HOT_LINES", hot)
    rows = [(i if i != 3 else None, t, "c") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string")
    model = lm.fit(docs.limit(9).select("doc_id", "text"), PATH, head=head)
    rows = [r.text for r in docs.limit(9).collect()]
    got = sorted(tuple(r)[1:] for r in lm.score(docs, model).collect())
    want = sorted(plain(TEXTS, model, rows))
    assert len(got) == len(TEXTS)
    for a, b in zip(got, want):
        assert a == pytest.approx(b)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = lm.fit(docs.limit(0), PATH)
    got = sorted(tuple(r)[1:] for r in lm.score(docs, model).collect())
    for a, b in zip(got, sorted(plain(["a b", None], model, []))):
        assert a == pytest.approx(b)
    assert lm.score(docs.limit(0), model).count() == 0


def test_probabilities_sum_to_at_most_one(spark):
    docs = spark.createDataFrame([(1, "ab ab c"), (2, "ab d")], "doc_id long, text string")
    model = lm.fit(docs, PATH)
    words = [bytes([a]) for a in range(33, 127)] + [bytes([a, b]) for a in range(33, 127) for b in range(33, 127)]
    seen = {b"ab": 3, b"c": 1, b"d": 1}
    total = sum(10 ** float(model.word_log10(float(model.head.get(w, 0)), model.spell(w))) for w in words)
    assert seen.keys() == model.head.keys() and 0.4 < total < 1


def test_query(spark, llm):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in llm["op6_lattice_lm"](spark, sf).collect()}
    assert rows.keys() == docs.keys()
    training = [t for i, t in docs.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    words = Counter(w for t in training for w in t.encode().lower().split())
    n, v = sum(words.values()) + len(training), len(words) + 1
    for i, r in rows.items():
        counts = [words[w] for w in docs[i].encode().lower().split()] + [len(training)]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(counts), sum(c > 0 for c in counts), n)
        assert r.base_score == pytest.approx(sum(math.log10((c + 1) / (n + v + 1)) for c in counts))
        assert r.score < 0
