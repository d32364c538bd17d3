"""Byte-level BPE encoding and decoding of whole texts.

Merging works on a segment tree over the ranks of adjacent pairs. Each leaf holds
`rank * positions + position` of the pair that begins there, so the root yields the leftmost pair
of the lowest rank. A merge changes three leaves, each with a logarithmic path to the root, until
the root says that no pair can be merged. A piece of n bytes takes O(n log n). Pieces of up to
64 bytes are merged many at a time, one tree per row of a matrix; longer ones one by one.

Vocabulary files are read where they lie (a parameter) by each Python worker, once.

Defined results: a null text is the empty text (no tokens); special tokens written in a text are
encoded as such; input columns named like result columns are replaced; rows are kept one to one.
"""

from __future__ import annotations

import functools
import hashlib
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from layerstack.llm.common import index_of, texts_of, with_arrow

#: The pre-tokenisation pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Bound of each task's memory of pieces already encoded, and of their length there.
MOST_PIECES, LONG_PIECE = 300_000, 64
#: Characters of texts handled together; bytes of a piece that is merged in a row among others; and
#: cells of such a group of rows.
GROUP_CHARS, WIDEST, CELLS = 2_000_000, 64, 1 << 19


def printable_bytes() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes, and their bytes."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PairTree:
    """Minimum tree over the pairs of a sequence; see the module's text."""

    def __init__(self, keys: list[int], none: int):
        size = 1
        while size < len(keys):
            size *= 2
        self.size, self.none = size, none
        tree = [none] * size + keys + [none] * (size - len(keys))
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        self.tree = tree

    def put(self, leaf: int, key: int) -> None:
        tree, i = self.tree, self.size + leaf
        tree[i] = key
        while i > 1:
            other = tree[i ^ 1]
            if other < key:
                key = other
            i >>= 1
            if tree[i] == key:
                return
            tree[i] = key


class Bpe:
    """A byte-level BPE vocabulary in the JSON form of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, as_byte = spec["model"]["vocab"], printable_bytes()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of: dict[int, bytes] = {
            i: bytes(as_byte[c] for c in piece)
            for piece, i in vocab.items()
            if piece not in self.special
        }
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.byte_id = [0] * 256
        for char, b in as_byte.items():
            self.byte_id[b] = vocab[char]
        #: Pair of ids (as one number) to rank and id of the merged piece.
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.merges[vocab[a] << 32 | vocab[b]] = (rank, vocab[a + b])
        self.none = 1 << 62
        order = sorted(self.merges)
        self.no_rank = len(order)
        self.pair_keys = np.array([*order, 1 << 62], np.int64)
        self.pair_ranks = np.array([*(self.merges[k][0] for k in order), self.no_rank], np.int64)
        self.merged_id = np.zeros(self.no_rank + 1, np.int64)
        for rank, new in self.merges.values():
            self.merged_id[rank] = new
        self.byte_ids = np.array(self.byte_id, np.int64)
        self.special_ids = {t: np.array([i], "<u4").tobytes() for t, i in self.special.items()}
        #: Packed ids of special tokens, and of pieces met before.
        self.known: dict[str, bytes] = dict(self.special_ids)
        self.split = regex.compile(PATTERN).findall
        self.find_special = (
            regex.compile("(" + "|".join(map(regex.escape, sorted(self.special))) + ")")
            if self.special
            else None
        )
        self.decimal = {i: str(i) for i in self.bytes_of}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        ids = [self.byte_id[b] for b in piece]
        n = len(ids)
        if n < 2:
            return ids
        merges, none = self.merges, self.none
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        keys = []
        for i in range(n - 1):
            found = merges.get(ids[i] << 32 | ids[i + 1])
            keys.append(found[0] * n + i if found else none)
        tree = PairTree(keys, none)
        while (best := tree.tree[1]) != none:
            i = best % n
            j = after[i]
            ids[i] = merges[ids[i] << 32 | ids[j]][1]
            ids[j] = -1
            k = after[i] = after[j]
            if j < n - 1:
                tree.put(j, none)
            if k < n:
                before[k] = i
                found = merges.get(ids[i] << 32 | ids[k])
                tree.put(i, found[0] * n + i if found else none)
            else:
                tree.put(i, none)
            h = before[i]
            if h >= 0:
                found = merges.get(ids[h] << 32 | ids[i])
                tree.put(h, found[0] * n + h if found else none)
        return [x for x in ids if x >= 0]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; `no_rank` where the vocabulary has no such merge."""
        pairs = left << 32 | right
        at = np.searchsorted(self.pair_keys, pairs)
        return np.where(self.pair_keys[at] == pairs, self.pair_ranks[at], self.no_rank)

    def merge_many(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Packed ids of pieces of at most `width` bytes (a power of two): one tree per row."""
        rows, none = len(pieces), self.no_rank * width
        lengths = np.fromiter(map(len, pieces), np.int64, rows)
        padded = b"".join(x.ljust(width, b"\0") for x in pieces)
        ids = self.byte_ids[np.frombuffer(padded, np.uint8)].reshape(rows, width)
        place = np.arange(width)
        ids[place >= lengths[:, None]] = -1
        after = np.repeat(place[None] + 1, rows, 0)
        before = np.repeat(place[None] - 1, rows, 0)
        tree = np.full((rows, 2 * width), none, np.int64)
        ranks = self._ranks(ids[:, :-1], ids[:, 1:])
        ranks[place[1:] >= lengths[:, None]] = self.no_rank
        tree[:, width:-1] = np.where(ranks < self.no_rank, ranks * width + place[:-1], none)
        size = width
        while size > 1:
            size //= 2
            level = tree[:, 2 * size : 4 * size]
            np.minimum(level[:, ::2], level[:, 1::2], out=tree[:, size : 2 * size])
        live = np.arange(rows)
        while len(live := live[tree[live, 1] < none]):
            best = tree[live, 1]
            i = best % width
            j = after[live, i]
            k = after[live, j]
            ids[live, i] = self.merged_id[best // width]
            ids[live, j] = -1
            after[live, i] = k
            ends = k >= lengths[live]
            k = np.minimum(k, width - 1)
            keep = np.flatnonzero(~ends)
            before[live[keep], k[keep]] = i[keep]
            here = np.where(ends, self.no_rank, self._ranks(ids[live, i], ids[live, k]))
            h = before[live, i]
            none_before = h < 0
            h = np.maximum(h, 0)
            there = np.where(none_before, self.no_rank, self._ranks(ids[live, h], ids[live, i]))
            tree[live, width + j] = none
            tree[live, width + i] = np.where(here < self.no_rank, here * width + i, none)
            key = np.where(there < self.no_rank, there * width + h, none)
            tree[live, width + h] = np.where(none_before, tree[live, width + h], key)
            nodes = [width + j, width + i, width + h]
            while nodes[0][0] > 1:
                nodes = [x >> 1 for x in nodes]
                for x in nodes:
                    tree[live, x] = np.minimum(tree[live, 2 * x], tree[live, 2 * x + 1])
        filled = ids >= 0
        ends = np.cumsum(filled.sum(1)) * 4
        flat = ids[filled].astype("<u4").tobytes()
        return [flat[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]

    def _learn(self, pieces: set[str]) -> None:
        """Put the packed ids of pieces into memory, those of like length together."""
        groups: dict[int, list[str]] = {}
        for piece in pieces:
            n = len(piece.encode())
            groups.setdefault(max(2, 1 << (n - 1).bit_length()), []).append(piece)
        for width, group in groups.items():
            if width > WIDEST:
                for piece in group:
                    packed = np.array(self.merge(piece.encode()), "<u4").tobytes()
                    self.known[piece] = packed
                continue
            step = max(1, CELLS // width)
            for i in range(0, len(group), step):
                part = group[i : i + step]
                packed = self.merge_many([x.encode() for x in part], width)
                self.known.update(zip(part, packed))

    def _pieces_of(self, text: str) -> list[str]:
        """The pieces of a text in order, special tokens among them."""
        if self.find_special is None or not self.find_special.search(text):
            return self.split(text)
        out: list[str] = []
        for part in self.find_special.split(text):
            out += [part] if part in self.special else self.split(part)
        return out

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts, as 4-byte unsigned numbers; texts of any length, in bounded groups."""
        out, group, chars = [], [], 0
        for text in texts:
            group.append(text)
            chars += len(text)
            if chars >= GROUP_CHARS:
                out += self._encode_group(group)
                group, chars = [], 0
        return out + self._encode_group(group)

    def _encode_group(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > MOST_PIECES:
            self.known = dict(self.special_ids)
        split = [self._pieces_of(t) for t in texts]
        new: set[str] = set()
        for pieces in split:
            new.update(pieces)
        new.difference_update(self.known)
        self._learn(new)
        known = self.known.__getitem__
        ids = [np.frombuffer(b"".join(map(known, pieces)), "<u4") for pieces in split]
        for piece in new:
            if len(piece) > LONG_PIECE:
                del self.known[piece]
        return ids

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]

    def forget(self) -> None:
        """Let go of the pieces met so far."""
        self.known = dict(self.special_ids)

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that form no character become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


@functools.cache
def load(path: str) -> Bpe:
    return Bpe(path)


def encode(
    df: DataFrame, vocabulary: str, text: str = "text", tokens: str = "tokens",
    check: str | None = None,
) -> DataFrame:
    """Adds the ids of each text (array of int) and their number (`n_tokens`).

    With `check`, adds a column of that name: whether the ids decode to the text.
    """
    at = index_of(df, text)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        bpe = load(vocabulary)
        texts = texts_of(batch, at)
        ids = bpe.encode_many(texts)
        ends = np.cumsum([0, *map(len, ids)])
        flat = pa.array(np.concatenate([np.empty(0, "<u4"), *ids]).astype("<i4"))
        return [
            pa.ListArray.from_arrays(pa.array(ends.astype("<i4")), flat),
            pa.array(np.diff(ends), pa.int64()),
            *([pa.array([bpe.decode(x.tolist()) == t for x, t in zip(ids, texts)])] if check else []),
        ]

    added = StructType(
        [StructField(tokens, ArrayType(IntegerType())), StructField("n_tokens", LongType())]
        + ([StructField(check, BooleanType())] if check else [])
    )
    return with_arrow(df, added, make, lambda: load(vocabulary).forget())


def decode(
    df: DataFrame, vocabulary: str, tokens: str = "tokens", text: str = "decoded"
) -> DataFrame:
    """Adds the text of each row's ids; null ids and a null list count as none."""
    at = index_of(df, tokens)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        bpe = load(vocabulary)
        lists = (x.as_py() for x in batch.column(at))
        texts = [bpe.decode([i for i in x or () if i is not None]) for x in lists]
        return [pa.array(texts, pa.string())]

    return with_arrow(df, StructType([StructField(text, StringType())]), make)


def digests(df: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """Encodes, decodes again, and adds only digests: for checks of whole corpora.

    Adds n_tokens, ids_sha256 (of decimal ids joined by commas) and decoded_sha256.
    """
    at = index_of(df, text)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        bpe = load(vocabulary)
        counts, ids_sha, decoded_sha = [], [], []
        for packed in bpe.encode_many(texts_of(batch, at)):
            ids = packed.tolist()
            counts.append(len(ids))
            joined = ",".join(map(bpe.decimal.__getitem__, ids))
            ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
            decoded_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
        return [pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)]

    added = StructType(
        [
            StructField("n_tokens", LongType()),
            StructField("ids_sha256", StringType()),
            StructField("decoded_sha256", StringType()),
        ]
    )
    return with_arrow(df, added, make, lambda: load(vocabulary).forget())
