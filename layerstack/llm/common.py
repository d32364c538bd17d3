"""Helpers shared by the operators: Arrow columns, word hashes, the shared folder."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that are turned into Python objects at once.
SLICE_ROWS = 500


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share.

    It is the session's `spark.checkpoint.dir`, else the folder given to setCheckpointDir. Without
    either, only a local master may go on, in the warehouse folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = set_dir.get() if set_dir.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
    return f"{folder.rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read again, which cuts its lineage.

    Results that were not yet read may need the files, so they go when the driver ends.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def let_go() -> None:
    """Give back to the system what a task no longer needs: its worker lives on, idle or for other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU library has it
    if trim is not None:
        trim(0)


def without(df: DataFrame, *names: str) -> DataFrame:
    """The table without columns that a result is about to add (in any case of letters)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def with_arrow(
    df: DataFrame,
    added: StructType,
    make: Callable[[pa.RecordBatch], list[pa.Array]],
    after: Callable[[], None] | None = None,
) -> DataFrame:
    """All columns plus those of `added`, which `make` computes from an Arrow batch.

    `make` sees every input column, of at most `SLICE_ROWS` rows; an input column named like an
    added one is replaced. `after` runs at the end of each task, to let go of memory, as workers live on.
    """
    taken = {n.lower() for n in added.names}
    kept = [i for i, c in enumerate(df.columns) if c.lower() not in taken]
    schema = StructType([df.schema[i] for i in kept] + list(added))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(i, SLICE_ROWS)
                arrays = [batch.column(k) for k in kept] + list(make(batch))
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
        if after:
            after()
        let_go()

    return df.mapInArrow(run, schema)


def index_of(df: DataFrame, column: str) -> int:
    """Position of a column, found as Spark finds it: whatever the case of its letters."""
    for i, name in enumerate(df.columns):
        if name.lower() == column.lower():
            return i
    raise ValueError(f"no column {column!r} among {df.columns}")


def texts_of(batch: pa.RecordBatch, i: int) -> list[str]:
    """The texts of a batch, null as the empty text."""
    return ["" if t is None else t for t in batch.column(i).to_pylist()]


class WordHashes(dict):
    """Word (bytes) to its 64-bit hash, kept for as many words as stated."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits (two multiply-xorshift rounds)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def gram_hashes(words: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hashes of all n-grams of a sequence of word hashes, in order."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(count, np.uint64(salt * 2 + 1), np.uint64)
        for k in range(n):
            out = (out ^ words[k : k + count]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return mix64(out)
