"""Counting hashed word sequences of a whole corpus without a row for each.

Documents are packed into rows of a few megabytes. Each pack sends its distinct hashes, with a small
payload, to buckets of the hash range as one binary value a bucket; a bucket sorts what all packs sent,
and answers every hash with one byte, in the order in which the pack sent it. Pack and answers meet
again by a cogroup. A hash that occurs in a third of all documents is one entry a pack. A pack is bounded, and
there are as many buckets as keep one to about `BUCKET_BYTES` by the input's size, up to `MOST_BUCKETS`.

The packs are computed twice, from the same scan. Each answer carries the number of hashes it is for and
a digest of them, and a pack that does not come out as before is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerstack.llm.common import WordHashes, let_go, mix64

PACK_BYTES, PACK_DOCS = 2_000_000, 20_000
#: A bucket's entries, if the input's size is known; and the finest cut of the hash range.
BUCKET_BYTES, MOST_BUCKETS = 64 << 20, 1 << 16
#: Bytes of entries for each byte of the input as it is stored (compressed).
ENTRY_SHARE = 4

PACKED = "pack long, ids array<long>, texts array<string>"


@dataclass
class Pack:
    """Word hashes of a pack's documents, one after another; document i ends at ends[i]."""

    ids: list[int | None]
    words: np.ndarray
    ends: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], self.ends[:-1]]).astype(np.int64)


def pack(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of many documents each: pack, ids, texts. A longer document is a pack of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() << 32) - 1
        held: list[pa.RecordBatch] = []

        def row() -> pa.RecordBatch:
            nonlocal number
            number += 1
            both = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            ends = pa.array([0, both.num_rows], pa.int32())
            lists = [
                pa.ListArray.from_arrays(ends, both.column(i).combine_chunks()) for i in (0, 1)
            ]
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), *lists], names=["pack", "ids", "texts"]
            )

        size = docs = 0
        for batch in batches:
            lengths = pa.compute.binary_length(batch.column(1)).fill_null(0).to_numpy(False)
            start = 0
            for i, n in enumerate(lengths.tolist()):
                if docs and (size + n > PACK_BYTES or docs >= PACK_DOCS):
                    held.append(batch.slice(start, i - start))
                    start, size, docs = i, 0, 0
                    yield row()
                size += n
                docs += 1
            held.append(batch.slice(start))
        if docs:
            yield row()
        let_go()

    import pyarrow.compute  # noqa: F401  (pa.compute)

    chosen = df.select(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`"))
    return chosen.mapInArrow(run, PACKED)


def split_words(ids: list, texts: list, hashes: WordHashes, lower: bool) -> tuple[Pack, list]:
    """Hash the words of each text; also returns the words themselves."""
    words = []
    for t in texts:
        data = (t or "").encode()
        words.append((data.lower() if lower else data).split())
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    flat = [w for row in words for w in row]
    return Pack(ids, hashes.of(flat), ends), words


def _rows(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple]:
    columns = [batch.column(i) for i in range(batch.num_columns)]
    for i in range(batch.num_rows):
        yield tuple(c[i].as_py() for c in columns)


def digest_of(hashes: np.ndarray) -> int:
    """A number that tells sets of hashes apart; that of a union is the sum, modulo 2^64."""
    with np.errstate(over="ignore"):
        return int(mix64(hashes).sum(dtype=np.uint64).view(np.int64))


def bucket_count(size: int, parts: int) -> int:
    """A power of two: at least two buckets for each partition, more where the input is large."""
    known = size if 0 < size < 1 << 60 else 0  # Spark gives a huge number where it does not know
    wanted = max(2 * parts, min(ENTRY_SHARE * known // BUCKET_BYTES, MOST_BUCKETS))
    return 1 << max(1, (wanted - 1).bit_length())


def ask(
    packs: DataFrame,
    entries: Callable[[list, list], tuple[np.ndarray, np.ndarray]],
    answer: Callable[[np.ndarray, np.ndarray], np.ndarray],
    width: int = 8,
) -> DataFrame:
    """Answers to each pack's entries: pack, bucket, n, digest, answers.

    entries(ids, texts) gives a pack's distinct hashes, ascending, and their payload (int64).
    answer(hashes, payload) gets all entries of a bucket and gives a byte for each. Hashes are sent
    by `width` bytes below the bits that the bucket stands for; with fewer than 8, different hashes
    may be one to the answers, which callers must allow for.
    """
    parts = max(1, int(packs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    plan = packs._jdf.queryExecution().optimizedPlan()
    size = max(int(str(leaf.stats().sizeInBytes())) for leaf in _leaves(plan))
    buckets = bucket_count(size, parts)
    bits = buckets.bit_length() - 1
    shift = np.uint64(64 - bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, ids, texts in _rows(batch):
                hashes, payload = entries(ids, texts)
                lower = (hashes << np.uint64(bits)) >> np.uint64(64 - 8 * width)
                if width == 8:
                    lower = hashes
                lower = np.ascontiguousarray(lower.view(np.uint8).reshape(-1, 8)[:, :width])
                cuts = np.searchsorted(hashes >> shift, np.arange(buckets + 1, dtype=np.uint64))
                out = [[], [], [], [], []]
                for b, (i, j) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())):
                    if i < j:
                        own = payload[i:j]
                        low = int(own.min())
                        narrow = (own - low).astype(np.min_scalar_type(int(own.max()) - low))
                        out[0].append(b)
                        out[1].append(lower[i:j].tobytes())
                        out[2].append(low)
                        out[3].append(narrow.tobytes())
                        out[4].append(digest_of(hashes[i:j]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number] * len(out[0]), pa.int64()), pa.array(out[0], pa.int32()),
                        pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64()),
                        pa.array(out[3], pa.binary()), pa.array(out[4], pa.int64()),
                    ],
                    names=["pack", "bucket", "hashes", "low", "payload", "digest"],
                )
        let_go()

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def settle() -> pa.RecordBatch:
            sizes = [len(r[2]) // width for r in held]
            hashes = np.zeros((sum(sizes), 8), np.uint8)
            hashes[:, :width] = np.frombuffer(b"".join(r[2] for r in held), np.uint8).reshape(
                -1, width
            )
            hashes = hashes.view(np.uint64)[:, 0]
            payload = np.concatenate(
                [
                    np.frombuffer(r[4], f"u{len(r[4]) // n}").astype(np.int64) + r[3]
                    for r, n in zip(held, sizes)
                ]
            )
            values = answer(hashes, payload).astype(np.uint8)
            cuts = np.cumsum([0, *sizes]).tolist()
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in held], pa.int64()),
                    pa.array([r[1] for r in held], pa.int32()),
                    pa.array(sizes, pa.int64()),
                    pa.array([r[5] for r in held], pa.int64()),
                    pa.array([values[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary()),
                ],
                names=["pack", "bucket", "n", "digest", "answers"],
            )
            held.clear()
            return out

        for batch in batches:
            for row in _rows(batch):
                if held and held[0][1] != row[1]:
                    yield settle()
                held.append(row)
        if held:
            yield settle()
        let_go()

    sent = packs.mapInArrow(
        send, "pack long, bucket int, hashes binary, low long, payload binary, digest long"
    )
    sent = sent.repartition(parts, "bucket").sortWithinPartitions("bucket", "pack")
    return sent.mapInArrow(reply, "pack long, bucket int, n long, digest long, answers binary")


def _leaves(plan) -> list:
    found = plan.collectLeaves()
    return [found.apply(i) for i in range(found.size())]


@dataclass
class Answers:
    """A byte for each of a pack's hashes, ascending, and what the hashes were when they were sent."""

    values: np.ndarray
    digest: int

    def to(self, hashes: np.ndarray) -> np.ndarray:
        """The answers to a pack's hashes as they are now: they must be those that were sent."""
        if len(hashes) != len(self.values) or digest_of(hashes) != self.digest:
            raise RuntimeError("a pack changed between two computations")
        return self.values


def join_answers(
    packs: DataFrame,
    answers: DataFrame,
    schema: str,
    make: Callable[[list, list, Answers], pa.RecordBatch],
) -> DataFrame:
    """Rows that make(ids, texts, answers) gives for each pack; answers are in order of hashes."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        (_, ids, texts) = next(_rows(left.select(["pack", "ids", "texts"])))
        rows = sorted(_rows(right.select(["bucket", "n", "digest", "answers"])))
        if sum(r[1] for r in rows) != sum(len(r[3]) for r in rows):
            raise RuntimeError("answers of a pack are not complete")
        values = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
        digest = sum(r[2] for r in rows) % (1 << 64)
        found = Answers(values, digest - (1 << 64) if digest >> 63 else digest)
        out = pa.Table.from_batches([make(ids, texts, found)])
        let_go()
        return out

    return packs.groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(run, schema)
