"""Row sources for passes over a table: feature columns as they are, or stored blocks.

A block table has one row per matrix block of some hundred kilobytes. Training re-reads it once per
epoch, and a block crosses from the JVM to Python as one memory copy. Values keep their source
type (four bytes for float features) and are scaled when read, so that packing needs no
earlier pass over the source: ranges and defects are stored with each block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from layerstack.operators.blocks import bounded, features_block, filled, scale_block
from layerstack.operators.sparse import SparseInput, sparse_inputs

# A block fits a core's second-level cache, but holds enough rows for matrix products to pay.
BLOCK_BYTES = 256 << 10
BLOCK_ROWS = 256
LARGE_BLOCK_BYTES = 32 << 20
# A block of ML vectors holds about this much of their stored values and indices.
VECTOR_BLOCK_BYTES = 1 << 20
# Weights above this size travel as a broadcast instead of inside the task closure.
CLOSURE_BYTES = 1 << 20
# Weights live on the driver and in every Python worker, so their size is bounded (by default).
MODEL_BYTES = 256 << 20
# A pass has a task for each split where that is at most this many (or four per core, if that is more),
# or where all partial sums together are at most this part of the data.
MIN_TASK_BOUND = 4096
PARTIAL_SHARE = 16

Ranges = tuple[np.ndarray, np.ndarray] | None
# A block is a matrix, or sparse rows where the source holds ML vectors.
Reader = Callable[
    [Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray | SparseInput, np.ndarray | None]]
]


def check_model_bytes(size: int, limit: int) -> None:
    """Refuse what the driver and every worker would have to hold."""
    if size > limit:
        raise ValueError(
            f"weights take {size} bytes; modelBytes allows {limit} (fit_blocked trains larger layers)"
        )


def result_bytes(spark: SparkSession) -> int:
    """How much one job may send to the driver."""
    conf = spark.sparkContext._jsc.sc().conf()
    return conf.getSizeAsBytes("spark.driver.maxResultSize", "1g") or 1 << 62


class Shared:
    """A value for tasks: in the closure when small, else one broadcast."""

    def __init__(self, spark: SparkSession, value: Any, arrays: list[np.ndarray]):
        large = sum(a.nbytes for a in arrays) > CLOSURE_BYTES
        self._broadcast = spark.sparkContext.broadcast(value) if large else None
        self._value = None if large else value

    def get(self) -> Any:
        return self._value if self._broadcast is None else self._broadcast.value

    def close(self) -> None:
        if self._broadcast is not None:
            self._broadcast.destroy()


def task_bound(spark: SparkSession, requested: int = 0) -> int:
    """Number of tasks (and partial results) that a pass may always have: it follows the cluster."""
    return requested or max(MIN_TASK_BOUND, 4 * spark.sparkContext.defaultParallelism)


def pass_tasks(
    spark: SparkSession, splits: int, cells: int, partial: int, requested: int = 0
) -> int:
    """Tasks of a pass over `cells` numbers in so many splits, with partial sums of `partial` numbers.

    A task for each split, so that it can run where its data are and little is done again if it is lost,
    unless that makes more than `task_bound` partial sums that come to more than a share of the data.
    """
    if requested:
        return max(1, min(splits, requested))
    affordable = cells // (PARTIAL_SHARE * max(1, partial))
    return max(1, min(splits, max(task_bound(spark), affordable)))


def feature_column(df: DataFrame, features: str | list[str]) -> Column:
    """Features as an array column: an array, an ML vector, or a list of numeric columns."""
    if isinstance(features, (list, tuple)):
        return F.array(*[F.col(c).cast("double") for c in features])
    kind = df.schema[features].dataType
    if kind.typeName() == "vectorudt":
        # Imported here, as tasks import this module and need nothing of pyspark.ml.
        from pyspark.ml.functions import vector_to_array

        return vector_to_array(F.col(features))
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.DoubleType, T.FloatType)):
            return F.col(features)
        return F.col(features).cast("array<double>")
    raise TypeError(f"column {features!r} is {kind.simpleString()}, not an array or vector")


def is_vector(df: DataFrame, features: str | list[str]) -> bool:
    """Whether the features are a column of ML vectors, which can be sparse."""
    return isinstance(features, str) and df.schema[features].dataType.typeName() == "vectorudt"


def stored_column(df: DataFrame, features: str | list[str]) -> Column:
    """Features as they are stored: ML vectors stay sparse, in their struct."""
    if is_vector(df, features):
        return F.unwrap_udt(F.col(features))
    return feature_column(df, features)


def _filled(column: pa.StructArray) -> pa.Array:
    """Lists of ML vectors, with their zeros."""
    kind, size, indices, values = column.flatten()
    held = pc.list_value_length(values).fill_null(0).to_numpy()
    sparse = kind.fill_null(1).to_numpy() == 0
    width = np.where(sparse, size.fill_null(0).to_numpy(), held)
    offsets = np.concatenate([[0], np.cumsum(width)])
    # The place of each stored value: told by its index, or its order in a dense vector.
    place = np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held)
    place[np.repeat(sparse, held)] = indices.filter(pa.array(sparse)).flatten().to_numpy()
    flat = np.zeros(offsets[-1])
    flat[place + np.repeat(offsets[:-1], held)] = values.flatten().to_numpy()
    mask = pa.array(~np.array(column.is_valid()))
    return pa.ListArray.from_arrays(pa.array(offsets.astype("i4")), pa.array(flat), mask=mask)


def list_parts(column: pa.Array) -> Iterator[pa.Array]:
    """A column of features as lists; ML vectors are filled with zeros a few blocks at a time."""
    if not pa.types.is_struct(column.type):
        yield column
        return
    _, size, _, values = column.flatten()
    widest = max(
        (pc.max(c).as_py() or 0 for c in (size, pc.list_value_length(values))), default=0
    )
    step = block_rows(widest)
    for at in range(0, len(column), step):
        yield _filled(column.slice(at, step))


def element_type(df: DataFrame, features: str | list[str]) -> str:
    """Numpy type that holds the features without loss."""
    if isinstance(features, str):
        kind = df.schema[features].dataType
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType):
            return "f4"
    return "f8"


def block_rows(width: int) -> int:
    """Rows per block."""
    row = 8 * max(width, 1)
    return max(1, min(max(BLOCK_ROWS, BLOCK_BYTES // row), LARGE_BLOCK_BYTES // row))


@dataclass(frozen=True)
class Source:
    """A DataFrame and how its tasks turn Arrow batches into (block, row keys)."""

    df: DataFrame
    width: int
    read: Reader

    def narrowed(self, tasks: int) -> DataFrame:
        """At most `tasks` partitions, without a shuffle."""
        return self.df.coalesce(tasks)


def _read_vectors(
    batches: Iterator[pa.RecordBatch], width: int, ranges: Ranges, keyed: bool, outside: str
) -> Iterator[tuple[np.ndarray | SparseInput, np.ndarray | None]]:
    step = block_rows(width)
    for batch in batches:
        keys = batch.column(1).to_numpy(zero_copy_only=False) if keyed else None
        first = 0
        if pa.types.is_struct(batch.schema.field(0).type):
            for x in sparse_inputs(batch.column(0), width, ranges, step):
                if outside != "keep":
                    x = bounded(filled(x), outside)
                yield x, None if keys is None else keys[first : first + len(x)]
                first += len(x)
            continue
        for lists in list_parts(batch.column(0)):
            x = features_block(lists, width)
            for at in range(0, len(x), step):
                part = bounded(scale_block(x[at : at + step], ranges), outside)
                yield part, None if keys is None else keys[first + at : first + at + step]
            first += len(x)


def vector_source(
    df: DataFrame, features: str | list[str], width: int, ranges: Ranges, ids: list[str],
    outside: str = "keep",
) -> Source:
    """Read a feature column directly: one hop to Python, nothing stored."""
    columns = [stored_column(df, features).alias("x")]
    if ids:
        columns.append(F.xxhash64(*ids).alias("key"))
    read = partial(_read_vectors, width=width, ranges=ranges, keyed=bool(ids), outside=outside)
    return Source(df.select(*columns), width, read)


def _read_blocks(
    batches: Iterator[pa.RecordBatch], width: int, dtype: str, ranges: Ranges
) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    for batch in batches:
        keys_column, x_column = batch.column(0), batch.column(1)
        for i in range(batch.num_rows):
            x = np.frombuffer(x_column[i].as_buffer(), dtype=dtype).reshape(-1, width)
            keys = None
            if keys_column[i].is_valid:
                keys = np.frombuffer(keys_column[i].as_buffer(), dtype="i8")
            yield scale_block(x, ranges), keys


def block_source(blocks: DataFrame, width: int, dtype: str, ranges: Ranges) -> Source:
    """Read a stored block table. Only keys and values are scanned."""
    read = partial(_read_blocks, width=width, dtype=dtype, ranges=ranges)
    return Source(blocks.select("keys", "x"), width, read)


CODE_SCHEMA = "rows int, keys binary, x binary"
_CODE_ARROW = pa.schema([("rows", pa.int32()), ("keys", pa.binary()), ("x", pa.binary())])

PACKED_SCHEMA = CODE_SCHEMA + ", null_rows int, bad int, lo binary, hi binary"
_PACKED_ARROW = pa.schema(
    [*_CODE_ARROW, ("null_rows", pa.int32()), ("bad", pa.int32()), ("lo", pa.binary()),
     ("hi", pa.binary())]
)


def _binary(values: np.ndarray | None) -> pa.Array:
    return pa.array([None if values is None else values.tobytes()], pa.binary())


def _count(n: int) -> pa.Array:
    return pa.array([n], pa.int32())


def _packed(x: np.ndarray, keys: np.ndarray | None, null_rows: int) -> pa.RecordBatch:
    rows, width = x.shape
    bad = int(np.isnan(x).sum())
    lo = hi = None
    if rows and width:
        lo = np.fmin.reduce(x, axis=0).astype("f8")
        hi = np.fmax.reduce(x, axis=0).astype("f8")
    return pa.RecordBatch.from_arrays(
        [_count(rows), _binary(keys), _binary(x), _count(null_rows), _count(bad), _binary(lo),
         _binary(hi)],
        schema=_PACKED_ARROW,
    )


def pack(df: DataFrame, features: str | list[str], ids: list[str]) -> DataFrame:
    """Block table of a feature column; only the features and ids are read.

    Null vectors are left out and counted, and vectors of different widths go to different
    blocks, for `block_profile` to report. With id columns, the row key is their hash.
    """
    dtype = element_type(df, features)
    keyed = bool(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            keys = batch.column(1).to_numpy(zero_copy_only=False) if keyed else None
            null_rows = column.null_count
            if null_rows:
                valid = column.is_valid().to_numpy(zero_copy_only=False)
                column, keys = column.drop_null(), None if keys is None else keys[valid]
            sizes = np.diff(column.offsets.to_numpy())
            if null_rows or not len(column):
                yield _packed(np.zeros((0, 0), dtype), None, null_rows)
            for width in np.unique(sizes):
                chosen = np.flatnonzero(sizes == width)
                same = column if len(chosen) == len(sizes) else column.take(pa.array(chosen))
                flat = same.flatten().to_numpy(zero_copy_only=False)
                x = flat.astype(dtype, copy=False).reshape(len(chosen), width)
                k = None if keys is None else keys[chosen]
                step = block_rows(width)
                for at in range(0, len(x), step):
                    yield _packed(
                        np.ascontiguousarray(x[at : at + step]),
                        None if k is None else k[at : at + step], 0,
                    )

    columns = [feature_column(df, features).alias("x")]
    if keyed:
        columns.append(F.xxhash64(*ids).alias("key"))
    return df.select(*columns).mapInArrow(run, PACKED_SCHEMA)


def pack_vectors(df: DataFrame, features: str, ids: list[str]) -> DataFrame:
    """Block table of a column of ML vectors, as sparse as they are: a block holds about a megabyte
    of stored values, in Arrow's stream format."""
    keyed = bool(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            keys = batch.column(1).to_numpy(zero_copy_only=False) if keyed else None
            step = max(1, len(column) * VECTOR_BLOCK_BYTES // max(1, column.nbytes))
            for at in range(0, len(column), step):
                part = pa.RecordBatch.from_arrays([column.slice(at, step)], ["x"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as stream:
                    stream.write_batch(part)
                yield pa.RecordBatch.from_arrays(
                    [
                        _count(part.num_rows),
                        _binary(None if keys is None else keys[at : at + step]),
                        pa.array([sink.getvalue().to_pybytes()], pa.binary()),
                    ],
                    schema=_CODE_ARROW,
                )

    columns = [stored_column(df, features).alias("x")]
    if keyed:
        columns.append(F.xxhash64(*ids).alias("key"))
    return df.select(*columns).mapInArrow(run, CODE_SCHEMA)


def _read_vector_blocks(
    batches: Iterator[pa.RecordBatch], width: int, ranges: Ranges
) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    for batch in batches:
        for keys, x in zip(batch.column(0), batch.column(1)):
            found = pa.ipc.open_stream(x.as_buffer()).read_next_batch()
            columns = [found.column(0)]
            if keys.is_valid:
                columns.append(pa.array(np.frombuffer(keys.as_buffer(), dtype="i8")))
            part = pa.RecordBatch.from_arrays(columns, ["x", "key"][: len(columns)])
            yield from _read_vectors(iter([part]), width, ranges, keys.is_valid, "keep")


def vector_block_source(blocks: DataFrame, width: int, ranges: Ranges) -> Source:
    """Read a table of packed ML vectors; sparse blocks stay sparse, others are filled with zeros."""
    read = partial(_read_vector_blocks, width=width, ranges=ranges)
    return Source(blocks.select("keys", "x"), width, read)


def map_blocks(
    source: Source, shared: Shared, f: Callable[[np.ndarray, Any], np.ndarray], tasks: int
) -> DataFrame:
    """Block table of `f(block, value)`, with the keys of the source, in at most `tasks` parts."""
    read = source.read

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = shared.get()
        for x, keys in read(batches):
            y = np.ascontiguousarray(f(x, value))
            yield pa.RecordBatch.from_arrays(
                [_count(len(y)), _binary(keys), _binary(y)], schema=_CODE_ARROW
            )

    return source.narrowed(tasks).mapInArrow(run, CODE_SCHEMA)


def heaviest_task(blocks: DataFrame, tasks: int) -> tuple[int, int]:
    """(rows of the fullest task, rows) of a pass over a block table; reads only the counts."""
    loads = (
        blocks.select("rows").coalesce(tasks)
        .groupBy(F.spark_partition_id().alias("task")).agg(F.sum("rows").alias("rows"))
    )
    found = loads.agg(F.max("rows").alias("most"), F.sum("rows").alias("rows")).first()
    return found.most or 0, found.rows or 0
