"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected to a few dimensions at random, once for each curve, shifted, and ordered along a
Hilbert curve. The orderings are cut into blocks of key ranges (quantiles, found by Spark). A query is
looked up in a window of neighbouring blocks around its own key on each curve, the windows' results
are merged, and the nearest are ranked by exact distances on the original vectors. A vector is sent to one
block of each curve, once; a block's queries stream past it, however many they are.

How wide a window must be depends on the vectors: where they lie in clusters, a narrow one does; where they
are spread evenly over many dimensions (the neighbours hardly nearer than the rest), it must hold a
large share of all to find nine of ten. `share` is a parameter, of the number of blocks, so recall does
not fall as tables grow.

Equal vectors are indexed once, with their `k` + 1 smallest ids, which is all a result can hold.

Defined results: vectors that are null, zero, hold null or non-finite components, or are not of the
most common length (the larger of two) take no part, nor do null ids; of rows with equal id and
vector one counts, and of rows with equal id and other vectors each; ties go to the smaller id; fewer
candidates than k are all returned; an empty table gives an empty table. Only id and vector are read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from layerstack.llm.common import stored

CURVES, PROJECTED, BITS, SHARE, SEED = 4, 4, 10, 0.4, 97
#: Rows of a block, blocks at most, and distances that are held at once.
BLOCK_ROWS, MOST_BLOCKS, CELLS = 2048, 16384, 1 << 20


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of integer points (rows), by Gray codes bit by bit."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations and reflections of each finer level
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & low
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] = np.where(high, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where(x[n - 1] & q, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    out = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | x[i] >> bit & 1
    return out


@functools.cache
def projections(width: int, curves: int, dims: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A random orthonormal projection and a shift (in widths of the grid's spread) for each curve."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(curves):
        basis, _ = np.linalg.qr(rng.normal(size=(width, width)))
        out.append((basis[:, : min(dims, width)], rng.uniform(-0.5, 0.5, min(dims, width))))
    return out


def curve_keys(vectors: np.ndarray, spread: float, curves: int, dims: int, bits: int, seed: int):
    """Keys of vectors (rows) on each curve (columns)."""
    keys = []
    for basis, shift in projections(vectors.shape[1], curves, dims, seed):
        unit = (vectors @ basis / spread + shift) / 9 + 0.5  # four spreads and the shift fit
        cells = np.clip(unit * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)
        keys.append(hilbert_index(cells, bits))
    return np.stack(keys, 1) if keys else np.empty((len(vectors), 0), np.int64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten() if hasattr(column, "flatten") else column.combine_chunks().flatten()
    return np.asarray(flat, np.float64).reshape(-1, width)


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """id and v (array of double) of the rows that take part."""
    v = F.col(f"`{vector}`").cast("array<double>")
    rows = df.select(F.col(f"`{vec_id}`").cast("long").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull()
        & F.col("v").isNotNull()
        & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("v", lambda x: x != 0)
    )
    return rows


def nearest(
    df: DataFrame,
    is_query,
    k: int = 10,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    curves: int = CURVES,
    share: float = SHARE,
    dims: int = PROJECTED,
    bits: int = BITS,
    seed: int = SEED,
) -> DataFrame:
    """The k nearest rows found for every row that is_query (a function of the id column) picks.

    Returns query_id, rank (from 1), vec_id and score (Euclidean distance).
    """
    spark = df.sparkSession
    rows = usable(df, vec_id, vector)
    lengths = rows.groupBy(F.size("v").alias("width")).count()
    common = lengths.orderBy(F.desc("count"), F.desc("width")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return spark.createDataFrame([], schema)
    width = common["width"]
    rows = rows.where(F.size("v") == width)

    first = Window.partitionBy("v").orderBy("id")
    distinct = rows.select("id", "v").withColumn("place", F.row_number().over(first))
    distinct = distinct.where(F.col("place") <= k + 1).groupBy("v").agg(
        F.array_sort(F.collect_set("id")).alias("ids")
    )
    distinct = stored(distinct, "ann-vectors")
    figures = distinct.agg(
        F.count("*").alias("n"),
        F.avg(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("square"),
    ).first()
    spread = math.sqrt(figures["square"] / width)
    blocks = max(1, min(MOST_BLOCKS, -(-figures["n"] // BLOCK_ROWS)))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = _matrix(batch.column(batch.schema.get_field_index("v")), width)
            keys = curve_keys(matrix, spread, curves, dims, bits, seed)
            ends = pa.array(np.arange(len(keys) + 1) * curves, pa.int32())
            column = pa.ListArray.from_arrays(ends, pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, column], names=[*batch.schema.names, "keys"]
            )

    data = distinct.mapInArrow(keyed, "v array<double>, ids array<long>, keys array<long>")
    data = data.select("v", "ids", F.posexplode("keys").alias("curve", "key"))
    probabilities = [i / blocks for i in range(1, blocks)]
    bounds = {c: [] for c in range(curves)}
    if probabilities:
        found = data.groupBy("curve").agg(
            F.percentile_approx("key", probabilities, F.lit(20 * blocks)).alias("b")
        )
        bounds |= {r["curve"]: r["b"] for r in found.collect()}
    limits = [np.array(bounds[c], np.int64) for c in range(curves)]

    @F.pandas_udf("int")
    def block_of(curve, key):
        import pandas as pd

        c, x = curve.to_numpy(), key.to_numpy()
        out = np.zeros(len(x), np.int32)
        for i, b in enumerate(limits):
            out[c == i] = np.searchsorted(b, x[c == i], "right")
        return pd.Series(out)

    queries = rows.where(is_query(F.col("id"))).select("id", "v").distinct()
    asked = queries.mapInArrow(keyed, "id long, v array<double>, keys array<long>")
    asked = asked.select("id", "v", F.posexplode("keys").alias("curve", "key"))
    half = math.ceil(share * blocks / 2)
    middle = block_of("curve", "key")
    asked = asked.withColumn("middle", F.least(F.greatest(middle, F.lit(half)), F.lit(max(half, blocks - 1 - half))))
    asked = asked.withColumn(
        "block",
        F.explode(F.sequence(
            F.greatest(F.col("middle") - half, F.lit(0)), F.least(F.col("middle") + half, F.lit(blocks - 1))
        )),
    )
    none = F.lit(None)
    asked = asked.select("curve", "block", "id", "v", none.cast("array<long>").alias("ids"))
    data = data.select(
        "curve", block_of("curve", "key").alias("block"), none.cast("long").alias("id"), "v", "ids"
    )
    both = data.unionByName(asked).repartition("curve", "block").sortWithinPartitions(
        "curve", "block", F.col("id").asc_nulls_first()
    )
    found = both.mapInArrow(
        functools.partial(search, width=width, k=k), "query_id long, ids array<long>, score double"
    )
    found = found.select("query_id", F.explode("ids").alias("vec_id"), "score").where(
        "vec_id <> query_id"
    )
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


class Block:
    """The vectors of a block, and which are nearest to a query."""

    def __init__(self, parts: list[np.ndarray], ids: list[list[int]]):
        self.vectors, self.ids = np.concatenate(parts), ids
        self.square = (self.vectors * self.vectors).sum(1)
        self.first = np.array([x[0] for x in ids])

    def nearest(self, queries: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
        """Query, place and distance of the k nearest vectors of each query; ties to the smaller id."""
        take = min(k, len(self.square))
        step = max(1, CELLS // len(self.square))
        for at in range(0, len(queries), step):
            some = queries[at : at + step]
            rough = self.square - 2 * (some @ self.vectors.T)
            bounds = np.partition(rough, take - 1, axis=1)[:, take - 1]
            bounds += 1e-9 * (np.abs(bounds) + (some * some).sum(1))
            for i, (row, bound) in enumerate(zip(rough, bounds)):
                near = np.flatnonzero(row <= bound)
                exact = np.sqrt(((self.vectors[near] - some[i]) ** 2).sum(1))
                for x in np.lexsort((self.first[near], exact))[:take].tolist():
                    yield at + i, int(near[x]), float(exact[x])


def search(batches: Iterator[pa.RecordBatch], width: int, k: int) -> Iterator[pa.RecordBatch]:
    """The k + 1 nearest vectors of a block for each of its queries: query_id, ids and score.

    Rows come sorted by curve and block, a block's vectors (without id) before its queries, which
    stream by, however many they are.
    """
    key, parts, ids, block = None, [], [], None
    for batch in batches:
        curve, number = (batch.column(c).to_numpy() for c in (0, 1))
        query = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
        new = np.ones(batch.num_rows, bool)
        new[1:] = (np.diff(curve) != 0) | (np.diff(number) != 0) | (query[1:] != query[:-1])
        cuts = [*np.flatnonzero(new).tolist(), batch.num_rows]
        matrix = _matrix(batch.column(3), width)
        for i, j in zip(cuts, cuts[1:]):
            if (curve[i], number[i]) != key:
                key, parts, ids, block = (curve[i], number[i]), [], [], None
            if not query[i]:
                parts.append(matrix[i:j])
                ids += batch.column(4).slice(i, j - i).to_pylist()
                continue
            if not parts:
                continue
            if block is None:
                block = Block(parts, ids)
            asked = batch.column(2).slice(i, j - i).to_numpy()
            found = list(block.nearest(matrix[i:j], k + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(asked[[f[0] for f in found]], pa.int64()),
                    pa.array([block.ids[f[1]] for f in found], pa.list_(pa.int64())),
                    pa.array([f[2] for f in found], pa.float64()),
                ],
                names=["query_id", "ids", "score"],
            )


def brute_force(vectors: dict[int, list[float]], query: int, k: int = 10) -> list[tuple[int, float]]:
    """The exact answer for one query, for tests and for measuring recall on samples."""
    ids = np.array([i for i in vectors if i != query])
    if not len(ids):
        return []
    matrix = np.array([vectors[i] for i in ids.tolist()], np.float64)
    distance = np.sqrt(((matrix - np.array(vectors[query], np.float64)) ** 2).sum(1))
    order = np.lexsort((ids, distance))[:k]
    return [(int(ids[i]), float(distance[i])) for i in order]
