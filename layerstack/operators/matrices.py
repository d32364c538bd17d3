"""Weight matrices as tables of row blocks.

A block holds as many whole rows of a matrix as fit `BLOCK_CELLS` numbers (at least one), so no row of
the table, and no group that makes one, is as large as a matrix.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Numbers in a block: 4 MB.
BLOCK_CELLS = 1 << 19

MODEL_SCHEMA = (
    "layer int, role string, n_in int, n_out int, first_row int, weights array<double>"
)
_MODEL_ARROW = pa.schema(
    [("layer", pa.int32()), ("role", pa.string()), ("n_in", pa.int32()),
     ("n_out", pa.int32()), ("first_row", pa.int32()), ("weights", pa.list_(pa.float64()))]
)


def model_table(
    spark: SparkSession, encoders: list[np.ndarray], decoders: list[np.ndarray],
    cells: int = BLOCK_CELLS,
) -> DataFrame:
    """`(layer, role, n_in, n_out, first_row, weights)`: row-major blocks, bias row first."""
    blocks = []
    for role, matrices in (("encoder", encoders), ("decoder", decoders)):
        for layer, m in enumerate(matrices, 1):
            step = max(1, cells // max(1, m.shape[1]))
            for at in range(0, m.shape[0], step):
                blocks.append((layer, role, m.shape[0] - 1, m.shape[1], at, m[at : at + step].ravel()))
    columns = list(zip(*blocks)) or [()] * len(_MODEL_ARROW)
    arrays = [pa.array(c, f.type) for c, f in zip(columns, _MODEL_ARROW)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=_MODEL_ARROW))


def matrices_of(table: DataFrame, role: str) -> list[np.ndarray]:
    """The matrices of one role, by layer, filled block by block (bounded by the model size)."""
    found = table.where(F.col("role") == role).orderBy("layer", "first_row").toArrow()
    out: dict[int, np.ndarray] = {}
    for batch in found.to_batches():
        layers, n_in, n_out, first = (
            batch.column(batch.schema.get_field_index(c)).to_pylist()
            for c in ("layer", "n_in", "n_out", "first_row")
        )
        weights = batch.column(batch.schema.get_field_index("weights"))
        for i, layer in enumerate(layers):
            matrix = out.setdefault(layer, np.full((n_in[i] + 1, n_out[i]), np.nan))
            rows = weights[i].values.to_numpy(zero_copy_only=False).reshape(-1, n_out[i])
            matrix[first[i] : first[i] + len(rows)] = rows
    return [out[layer] for layer in sorted(out)]


def flatten_weights(table: DataFrame) -> DataFrame:
    """`(layer, role, row, col, pos, w)`: the long form of a model table."""
    place = F.col("first_row").cast("long") * F.col("n_out") + F.col("at")
    return table.select(
        "layer", "role", "n_out", "first_row", F.posexplode("weights").alias("at", "w")
    ).select(
        "layer",
        "role",
        (F.col("first_row") + F.floor(F.col("at") / F.col("n_out"))).cast("int").alias("row"),
        (F.col("at") % F.col("n_out")).cast("int").alias("col"),
        place.alias("pos"),
        "w",
    )


def assemble_weights(long: DataFrame, cells: int = BLOCK_CELLS) -> DataFrame:
    """Model table of a long table; the reverse of `flatten_weights`."""
    shapes = long.groupBy("layer", "role").agg(
        F.max("row").cast("int").alias("n_in"), (F.max("col") + 1).cast("int").alias("n_out")
    )
    step = F.greatest(F.lit(1), F.floor(F.lit(cells) / F.col("n_out"))).cast("int")
    # Two rows for each layer, so they can go to all tasks.
    placed = long.join(F.broadcast(shapes), ["layer", "role"]).withColumn(
        "first_row", (F.col("row") - F.col("row") % step).cast("int")
    )
    return (
        placed.groupBy("layer", "role", "n_in", "n_out", "first_row")
        .agg(F.array_sort(F.collect_list(F.struct("row", "col", "w"))).alias("cells"))
        .select("layer", "role", "n_in", "n_out", "first_row",
                F.transform("cells", lambda c: c["w"]).alias("weights"))
    )


def transpose_weights(long: DataFrame) -> DataFrame:
    """Swap rows and columns of every matrix in a long table."""
    return long.select("layer", "role", F.col("col").alias("row"), F.col("row").alias("col"), "w")


def weight_norms(long: DataFrame) -> DataFrame:
    """`(layer, role, square_sum, norm)`: squared sum without the bias row; norm with it."""
    square = F.col("w") * F.col("w")
    return long.groupBy("layer", "role").agg(
        F.sum(F.when(F.col("row") > 0, square).otherwise(0.0)).alias("square_sum"),
        F.sqrt(F.sum(square)).alias("norm"),
    )
