"""Removal of word sequences that documents with smaller ids hold, by relative Lempel-Ziv parsing.

The reference of a document is all documents with smaller ids, cut into `BLOCKS` blocks by a hash of the id. Every
window of `WINDOW` words is indexed in the block of the first document that has it; the index lives in
Spark's partitions, by ranges of window hashes, and tells a document for each of its windows which
block has it, in one byte. So a document is looked up in every block at once, without being sent to each.

The parse is greedy: a factor starts at the first word whose window a block has, and goes on as long as that block
has the next window too. Where it ends, or another block has the next window, the next factor
starts; windows that begin in the last words of a factor, across its boundary, are looked up like all others, so
factors may overlap and no window is missed between two. Factors have at least `WINDOW` words, and
the spans that they cover together are the duplicate spans.

Windows are named by 64 bits of a hash; with n windows, a window is taken for another with probability
n / 2^64 (five in a million at 10^14 windows).

Defined results: a null text has no words; a null id is smaller than all others; equal ids do not remove
each other's words; a text of fewer words than a window is kept; rows are kept one to one, and only
id and text are read; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from layerstack.llm.common import WordHashes, gram_hashes, mix64
from layerstack.llm.packs import Answers, Pack, ask, join_answers, pack, split_words

WINDOW = 13
#: Blocks of the reference: as many as a byte can name, besides none.
BLOCKS = 255
NULL_ID = -(1 << 63)


def windows(p: Pack, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows within one document, and the word at which each starts."""
    hashes = gram_hashes(p.words, size, salt=size)
    inside = np.ones(len(hashes), bool)
    for k in range(1, size):  # windows that begin in a document's last words reach into the next
        at = p.ends - k
        at = at[(at >= 0) & (at < len(hashes))]
        inside[at] = False
    starts = np.flatnonzero(inside)
    return hashes[starts], starts


def document_of(p: Pack, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(p.ends, at, "right")


def block_of(ids: np.ndarray) -> np.ndarray:
    """The block that a document is in, from 1."""
    return (mix64(ids.astype(np.int64).view(np.uint64)) % np.uint64(BLOCKS) + np.uint64(1)).astype(np.uint8)


def factors(blocks: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Greedy parse: (start, end, block) of factors, from the block that has the window at each word (0: none)."""
    out: list[tuple[int, int, int]] = []
    for at in np.flatnonzero(blocks).tolist():
        block = int(blocks[at])
        # The window one word on, in the same block, makes the factor longer; any other begins one.
        if out and out[-1][2] == block and out[-1][1] == at + size - 1:
            out[-1] = (out[-1][0], at + size, block)
        else:
            out.append((at, at + size, block))
    return out


def spans(found: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The spans that factors cover together."""
    out: list[tuple[int, int]] = []
    for start, end, _ in found:
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def _entries(p: Pack, size: int):
    """Distinct windows of a pack with their smallest id; and each window's place among them."""
    hashes, starts = windows(p, size)
    ids = np.array([NULL_ID if i is None else i for i in p.ids], np.int64)
    own = ids[document_of(p, starts)] if len(starts) else np.empty(0, np.int64)
    distinct, place = np.unique(hashes, return_inverse=True)
    first = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(first, place, own)
    return distinct, first, place, own, starts


def _earlier(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each entry, the block of the first document with its window if that has a smaller id, else 0."""
    order = np.argsort(hashes, kind="stable")
    sorted_hashes = hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = sorted_hashes[1:] != sorted_hashes[:-1]
    group = np.cumsum(new) - 1
    least = np.minimum.reduceat(first[order], np.flatnonzero(new))
    out = np.empty(len(order), np.uint8)
    out[order] = np.where(least[group] < first[order], block_of(least)[group], 0)
    return out


def duplicate_spans(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW
) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, factors, spans, kept (text), kept_sha256.

    factors have start and end words and the block of the reference, spans start and end; kept holds
    the words that stay, joined by one space.
    """
    packs = pack(df, doc_id, text)
    memory = WordHashes()

    def entries(ids, texts):
        distinct, first, *_ = _entries(split_words(ids, texts, memory, False)[0], window)
        return distinct, first

    answers = ask(packs, entries, _earlier)

    def make(ids, texts, answers: Answers) -> pa.RecordBatch:
        p, words = split_words(ids, texts, memory, False)
        distinct, first, place, own, starts = _entries(p, window)
        found = answers.to(distinct)
        blocks = np.zeros(len(p.words) + 1, np.uint8)
        if len(starts):
            # No other pack has an earlier one: then the first in this pack, unless that is the document.
            here = np.where(own > first[place], block_of(first)[place], 0)
            blocks[starts] = np.where(found[place] > 0, found[place], here)
        columns: list[list] = [[], [], [], [], [], [], []]
        for i, (begin, end) in enumerate(zip(p.starts.tolist(), p.ends.tolist())):
            parsed = factors(blocks[begin:end], window)
            covered = spans(parsed)
            row, kept, at = words[i], [], 0
            for a, b in covered:
                kept += row[at:a]
                at = b
            kept += row[at:]
            joined = b" ".join(kept)
            values = (
                ids[i], len(row), len(row) - len(kept),
                [{"start": a, "end": b, "block": c} for a, b, c in parsed],
                [{"start": a, "end": b} for a, b in covered],
                joined.decode(), hashlib.sha256(joined).hexdigest(),
            )
            for column, value in zip(columns, values):
                column.append(value)
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        factor = pa.struct([*span, ("block", pa.int32())])
        types = [
            pa.int64(), pa.int64(), pa.int64(), pa.list_(factor), pa.list_(span), pa.string(), pa.string(),
        ]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)],
            names=["doc_id", "n_words", "n_removed", "factors", "spans", "kept", "kept_sha256"],
        )

    schema = (
        "doc_id long, n_words long, n_removed long, "
        "factors array<struct<start: long, end: long, block: int>>, "
        "spans array<struct<start: long, end: long>>, kept string, kept_sha256 string"
    )
    return join_answers(packs, answers, schema, make)
