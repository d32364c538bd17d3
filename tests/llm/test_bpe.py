"""BPE against the tokenizers library, whose files it reads."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from layerstack.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
THEIRS = Tokenizer.from_file(PATH)
MINE = bpe.Bpe(PATH)

EDGES = [
    "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a \n b", "I'll've 'd 's''s", "x y", "\u0085z",
    "\x1c \x1f", "<|endoftext|>", "a<|endoftext|> b <|endoftext|>", "naïve É ß ñ 中文 😀 \U0001F468‍\U0001F469",
    "123456 7,8", "a\tb \t c", "\r\n\r\n x", "a" * 3000, "ab" * 2000, "!!! ### %%%\n$$$", "é ̀",
]


def test_edges():
    for text in EDGES:
        ids = MINE.encode(text).tolist()
        assert ids == THEIRS.encode(text, add_special_tokens=False).ids, repr(text)
        assert MINE.decode(ids) == THEIRS.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60) | st.text(" \n\tab'sr<|>.1é", max_size=40))
def test_any_text(text):
    ids = MINE.encode(text).tolist()
    assert ids == THEIRS.encode(text, add_special_tokens=False).ids
    assert MINE.decode(ids) == THEIRS.decode(ids, skip_special_tokens=False)


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MOST_PIECES", 5)
    monkeypatch.setattr(bpe, "GROUP_CHARS", 20)
    own = bpe.Bpe(PATH)
    texts = [*EDGES, "many different words in here", "", "x" * 90]
    for _ in range(2):
        for text, ids in zip(texts, own.encode_many(texts)):
            assert ids.tolist() == THEIRS.encode(text, add_special_tokens=False).ids
    assert all(len(k) <= bpe.LONG_PIECE for k in own.known)


def test_ids_that_form_no_character():
    rng = random.Random(1)
    for _ in range(50):
        ids = [rng.randrange(50257) for _ in range(8)]
        assert MINE.decode(ids) == THEIRS.decode(ids, skip_special_tokens=False)


def test_tree_matches_plain_merging():
    def plain(piece):
        ids = [MINE.byte_id[b] for b in piece]
        while True:
            found = [
                (MINE.merges[a << 32 | b][0], i)
                for i, (a, b) in enumerate(zip(ids, ids[1:]))
                if a << 32 | b in MINE.merges
            ]
            if not found:
                return ids
            _, i = min(found)
            ids[i : i + 2] = [MINE.merges[ids[i] << 32 | ids[i + 1]][1]]

    rng = random.Random(2)
    for _ in range(300):
        piece = bytes(rng.choice(b"abcthern ing\xc3\xa9") for _ in range(rng.randrange(1, 40)))
        assert MINE.merge(piece) == plain(piece)
        for width in (64, 256):
            packed = MINE.merge_many([piece], width)
            assert np.frombuffer(packed[0], "<u4").tolist() == plain(piece)


def test_operators(spark):
    rows = [(1, "the cat", 9), (1, "the cat", 9), (None, None, 0), (2, "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_Tokens int")
    out = bpe.decode(bpe.encode(df, PATH), PATH)
    assert out.columns == ["doc_id", "text", "tokens", "n_tokens", "decoded"]
    for r in out.collect():
        assert r.tokens == THEIRS.encode(r.text or "").ids and r.n_tokens == len(r.tokens)
        assert r.decoded == (r.text or "")
    empty = bpe.decode(bpe.encode(df.limit(0), PATH), PATH)
    assert empty.count() == 0
    with pytest.raises(ValueError):
        bpe.encode(df, PATH, text="body")
    odd = spark.createDataFrame([(None,), ([262, None],)], "tokens array<int>")
    assert {r.decoded for r in bpe.decode(odd, PATH).collect()} == {"", " the"}


def test_query(spark, sf_dir, llm):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = llm["op1_bpe"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = THEIRS.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        decoded = THEIRS.decode(ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
