"""Sums of vectors over all blocks of a table."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerstack.operators.tables import Source, result_bytes

# Largest total of partial sums that is brought to the driver directly.
COLLECT_BYTES = 256 << 20
# Largest group of partial chunks that one step of the tree adds up, and how many it has if it can.
REDUCE_BYTES = 256 << 20
FAN = 32
# Tasks of one level of the tree.
MOST_REDUCE_TASKS = 4096

PARTIAL_SCHEMA = "chunk int, bucket int, part int, v binary"
_PARTIAL_ARROW = pa.schema(
    [("chunk", pa.int32()), ("bucket", pa.int32()), ("part", pa.int32()), ("v", pa.binary())]
)


def partial_row(chunk: int, bucket: int, part: int, v: np.ndarray) -> pa.RecordBatch:
    places = [pa.array([n], pa.int32()) for n in (chunk, bucket, part)]
    return pa.RecordBatch.from_arrays(
        [*places, pa.array([v.tobytes()], pa.binary())], schema=_PARTIAL_ARROW
    )


Combine = Callable[[int, np.ndarray, np.ndarray], np.ndarray]


def _added(chunk: int, total: np.ndarray, v: np.ndarray) -> np.ndarray:
    total += v
    return total


def _combine_runs(batches: Iterator[pa.RecordBatch], combine: Combine) -> Iterator[pa.RecordBatch]:
    """Combine consecutive partials of the same (chunk, bucket); input is sorted."""
    current: tuple[int, int] | None = None
    total = np.zeros(0)
    for batch in batches:
        chunks = batch.column(0).to_pylist()
        buckets = batch.column(1).to_pylist()
        for i in range(batch.num_rows):
            v = np.frombuffer(batch.column(3)[i].as_buffer(), dtype="f8")
            if (chunks[i], buckets[i]) == current:
                total = combine(chunks[i], total, v)
                continue
            if current is not None:
                yield partial_row(*current, 0, total)
            current, total = (chunks[i], buckets[i]), v.copy()
    if current is not None:
        yield partial_row(*current, 0, total)


def reduce_partials(rows: DataFrame, tasks: int, combine: Combine = _added) -> DataFrame:
    """Combine partial vectors by (chunk, bucket), in the order of their parts."""
    return (
        rows.repartition(tasks, "chunk", "bucket")
        .sortWithinPartitions("chunk", "bucket", "part")
        .mapInArrow(lambda batches: _combine_runs(batches, combine), PARTIAL_SCHEMA)
    )


def tree_totals(
    rows: DataFrame, parts: int, chunks: int, fan: int, combine: Combine = _added,
    most_tasks: int = MOST_REDUCE_TASKS,
) -> DataFrame:
    """One total per chunk, of partials with parts from 0 to `parts` - 1.

    `combine(chunk, total, v)` takes a partial into a total; sums if left out. They are combined level by level, in groups of at most `fan` neighbouring parts, so no task reads more
    than that many partials of a chunk, however many tasks made them; the sums are repeatable.
    """
    if fan < 2:
        raise ValueError("groups hold two partials or more")
    while True:
        groups = -(-parts // fan)
        rows = rows.withColumn("bucket", F.floor(F.col("part") / fan).cast("int"))
        rows = reduce_partials(rows, max(1, min(groups * chunks, most_tasks)), combine)
        if groups == 1:
            return rows
        rows = rows.withColumn("part", F.col("bucket"))
        parts = groups


def tree_layout(size: int, reduce_bytes: int) -> tuple[int, int]:
    """(chunk length, fan) of a tree for vectors of a size; a group holds about `reduce_bytes`."""
    length = min(size, max(1024, reduce_bytes // (8 * FAN)))
    return length, max(2, reduce_bytes // (8 * length))


def sum_blocks(
    source: Source,
    size: int,
    add: Callable[[np.ndarray, np.ndarray, np.ndarray | None], None],
    partials: int,
    collect_bytes: int = COLLECT_BYTES,
    reduce_bytes: int = REDUCE_BYTES,
) -> np.ndarray | None:
    """Sum of a vector of length `size` over all blocks; None without rows.

    Each task calls `add(total, block, keys)` to add its blocks into one vector; there are at most
    `partials` tasks. When all those vectors together are small they come straight to the driver; beyond
    that they are cut into chunks, which a tree of shuffles adds up, and only the total comes. Partials
    are added in partition order, so a sum is repeatable.
    """
    limit = result_bytes(source.df.sparkSession)
    if 8 * size > limit // 2:
        raise ValueError(
            f"one total takes {8 * size} bytes: set spark.driver.maxResultSize to twice as much"
        )
    direct = partials * size * 8 <= min(collect_bytes, limit // 2)
    length, fan = (size, 2) if direct else tree_layout(size, reduce_bytes)
    read = source.read

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x, keys in read(batches):
            if total is None:
                total = np.zeros(size)
            add(total, x, keys)
        if total is None:
            return
        part = TaskContext.get().partitionId()
        for chunk, at in enumerate(range(0, size, length)):
            yield partial_row(chunk, 0, part, total[at : at + length])

    rows = source.narrowed(partials).mapInArrow(run, PARTIAL_SCHEMA)
    if not direct:
        rows = tree_totals(rows, partials, math.ceil(size / length), fan)
    found = sorted(rows.collect(), key=lambda r: (r.chunk, r.part))
    if not found:
        return None
    result = np.zeros(size)
    for r in found:
        at = r.chunk * length
        result[at : at + length] += np.frombuffer(r.v, dtype="f8")
    return result
