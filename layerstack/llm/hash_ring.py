"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Each shard has `POINTS` virtual nodes on a ring of hash values, and a key belongs to the next node clockwise.
A shard takes rows up to its capacity, (1 + slack) times its fair share of rows or bytes; what does not fit
goes on clockwise to the next node whose shard has room. So no shard holds more than its capacity,
and a key keeps its shard when shards are added unless a node comes in between or a bound is met.

Who overflows is settled by whole arcs, the pieces of the ring between two nodes. Rows are sorted along
the ring by a range partitioning of ids, sizes and checksums (no texts), which cuts a key that holds a third of
all rows like any other, and numbered within their arc. The plan needs only the load of each arc: arcs try
their nodes in rounds, a shard accepts arcs in ring order while there is room and cuts the one that does not fit,
and the rest tries the next node with room. The plan has shards x points arcs, whatever the table, and is made on the driver; a
piece of an arc is then an interval of running sums, and a row belongs to the piece in which it starts.

With load "rows" and no slack the capacities add up to the rows, so counts differ by one at most. With
load "bytes" a shard may exceed its capacity by the row that begins within it, once for each cut.

Slots number the rows of a shard from 0 without gaps, by piece and place on the ring.

Defined results: a null text has no bytes; null keys are one key; rows of one key are ordered by checksum
and size, and rows that agree in all of these may swap places; rows are kept one to one; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from layerstack.llm.common import index_of, stored

#: Virtual nodes of each shard.
POINTS = 64
#: Bytes that a row counts beyond its text.
ROW_BYTES = 16
RING = 1 << 64


def ring(shards: int, points: int = POINTS) -> tuple[np.ndarray, np.ndarray]:
    """Places of the virtual nodes in order, as signed numbers, and the shard of each."""
    nodes = sorted(
        (xxhash.xxh3_64_intdigest(f"shard {s} node {p}".encode()) - RING // 2, s)
        for s in range(shards)
        for p in range(points)
    )
    return np.array([n[0] for n in nodes], np.int64), np.array([n[1] for n in nodes], np.int64)


def capacities(total: int, shards: int, slack: float = 0.0) -> list[int]:
    """Most that each shard takes; without slack they add up to the total."""
    if slack < 0:
        raise ValueError("slack is 0 or more")
    if slack:
        return [int(-(-total * (1 + slack) // shards))] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def plan(loads: dict[int, int], owners: np.ndarray, room: list[int]) -> list[tuple[int, int, int, int]]:
    """Pieces (arc, start, end, shard) into which arcs of these loads are cut.

    Arc j ends at node j; the last one, behind all nodes, ends at node 0. room is what each shard can take.
    """
    room = list(room)
    if sum(loads.values()) > sum(room):
        raise ValueError("the shards have too little room")
    nodes = len(owners)
    pieces: list[tuple[int, int, int, int]] = []
    # node, arc, start, end
    waiting = sorted((j % nodes, j, 0, load) for j, load in loads.items() if load)
    while waiting:
        rest = []
        for node, arc, start, end in waiting:
            shard = int(owners[node])
            fits = min(room[shard], end - start)
            if fits:
                room[shard] -= fits
                pieces.append((arc, start, start + fits, shard))
            if start + fits < end:
                rest.append((node, arc, start + fits, end))
        # The next node clockwise whose shard has room, for every node.
        following, upcoming = [0] * nodes, None
        for k in range(2 * nodes - 1, -1, -1):
            if k < nodes:
                following[k] = upcoming
            if room[owners[k % nodes]]:
                upcoming = k % nodes
        waiting = sorted((following[node], arc, start, end) for node, arc, start, end in rest)
    return sorted(pieces)


def _along_ring(df: DataFrame, key: str, text: str, shards: int, points: int) -> DataFrame:
    """Ids, sizes and checksums in order of the ring, with arc, part and what comes before in their (part, arc)."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = df.select(
        F.col(f"`{key}`"),
        (F.octet_length(body) + ROW_BYTES).cast("long").alias("_size"),
        F.crc32(body.cast("binary")).alias("_crc32"),
        F.xxhash64(F.col(f"`{key}`").cast("string")).alias("_place"),
        F.xxhash64(F.monotonically_increasing_id()).alias("_salt"),
    )
    order = ["_place", "_crc32", "_size", "_salt"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_salt")
    places, _ = ring(shards, points)
    place_at, size_at = index_of(rows, "_place"), index_of(rows, "_size")
    added = [StructField(n, LongType()) for n in ("_arc", "_part", "_rank", "_ahead")]
    schema = StructType([*rows.drop("_place").schema.fields, *added])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        now, count, load = -1, 0, 0  # the arc so far, and what of it has gone by
        for batch in batches:
            if not batch.num_rows:
                continue
            arcs = np.searchsorted(places, batch.column(place_at).to_numpy())
            sizes = batch.column(size_at).to_numpy()
            starts = np.flatnonzero(np.diff(arcs, prepend=arcs[0] - 1))
            before = np.cumsum(sizes) - sizes
            run = np.repeat(starts, np.diff(starts, append=len(arcs)))
            rank, ahead = np.arange(len(arcs)) - run, before - before[run]
            if arcs[0] == now:
                rank[run == 0] += count
                ahead[run == 0] += load
            now, count, load = int(arcs[-1]), int(rank[-1]) + 1, int(ahead[-1] + sizes[-1])
            columns = [c for i, c in enumerate(batch.columns) if i != place_at]
            numbers = [arcs, np.full(len(arcs), part), rank, ahead]
            columns += [pa.array(a.astype(np.int64)) for a in numbers]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(number, schema)


def assign(
    df: DataFrame,
    shards: int,
    key: str = "doc_id",
    text: str = "text",
    points: int = POINTS,
    load: str = "rows",
    slack: float = 0.0,
) -> DataFrame:
    """Per row: the key, size (bytes of the text and `ROW_BYTES`), text_crc32, shard and slot.

    load says what is bounded: rows or bytes.
    """
    if load not in ("rows", "bytes"):
        raise ValueError("load is rows or bytes")
    if shards < 1 or points < 1:
        raise ValueError("there are one or more shards, each with one or more points")
    _, owners = ring(shards, points)
    rows = stored(_along_ring(df, key, text, shards, points), "ring")
    ahead = F.col("_rank") if load == "rows" else F.col("_ahead")
    rows = rows.withColumn("_own", ahead)
    # One row for each part of each arc: at most the number of parts and of arcs together.
    parts = rows.groupBy("_part", "_arc").agg(
        F.count("*").alias("rows"),
        (F.count("*") if load == "rows" else F.sum("_size")).cast("long").alias("load"),
    )
    earlier = Window.partitionBy("_arc").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored(
        parts.withColumns(
            {
                "rows_before": F.coalesce(F.sum("rows").over(earlier), F.lit(0)),
                "load_before": F.coalesce(F.sum("load").over(earlier), F.lit(0)),
            }
        ),
        "ring-parts",
    )
    # One row for each arc: shards x points at most.
    loads = {r["_arc"]: r["load"] for r in parts.groupBy("_arc").agg(F.sum("load").alias("load")).collect()}
    pieces = plan(loads, owners, capacities(sum(loads.values()), shards, slack))
    spark = df.sparkSession
    numbered = [
        (arc, i, *piece)
        for arc, own in groupby(pieces, key=lambda p: p[0])
        for i, (_, *piece) in enumerate(own)
    ]
    table = spark.createDataFrame(numbered, "_arc long, _piece int, _start long, _end long, shard int")
    cuts = parts.join(F.broadcast(table), "_arc").where(
        "_start < load_before + load AND _end > load_before"
    ).select("_part", "_arc", "_piece", "_start", "_end", "shard", "rows_before", "load_before")
    place = F.col("_own") + F.col("load_before")
    placed = rows.join(F.broadcast(cuts), ["_part", "_arc"]).where(
        (place >= F.col("_start")) & (place < F.col("_end"))
    ).withColumn("_rank", F.col("_rank") + F.col("rows_before"))
    # Where the rows of each piece begin: in their arc, and in their shard.
    runs = placed.groupBy("shard", "_arc", "_piece").agg(
        F.min("_rank").alias("_first"), F.count("*").alias("_rows")
    )
    by_shard = Window.partitionBy("shard").orderBy("_arc", "_piece").rowsBetween(
        Window.unboundedPreceding, -1
    )
    runs = runs.withColumn("_base", F.coalesce(F.sum("_rows").over(by_shard), F.lit(0)))
    runs = stored(runs.select("_arc", "_piece", "_first", "_base"), "ring-runs")
    return placed.join(F.broadcast(runs), ["_arc", "_piece"]).select(
        F.col(f"`{key}`"),
        F.col("_size").alias("size"),
        F.col("_crc32").alias("text_crc32"),
        "shard",
        (F.col("_base") + F.col("_rank") - F.col("_first")).cast("long").alias("slot"),
    )
