"""Weights as text: a header naming the layer sizes, then one number per line."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerstack.operators.matrices import flatten_weights, model_table

# The parts of the text layout.
HEADER_SUFFIX = "_UnsupervisedAE"
FILE_SUFFIX = "AE.csv"

# Lines of a part of the text.
PART_LINES = 1 << 20


def text_lines(table: DataFrame, sizes: list[int]) -> DataFrame:
    """`(layer, pos, value)`: the lines of the text layout; the header comes as layer 0."""
    return _lines(table, sizes).select("layer", "pos", "value")


def _lines(table: DataFrame, sizes: list[int]) -> DataFrame:
    """The same with `line`, the place in the whole text, as each layer's offset is known."""
    header = "_".join(str(n) for n in sizes) + HEADER_SUFFIX
    counts = [(n + 1) * k for n, k in zip(sizes, sizes[1:])]
    before = np.concatenate([[1], 1 + np.cumsum(counts)]).tolist()
    offset = F.element_at(F.array(*[F.lit(int(b)) for b in before]), F.col("layer"))
    lines = flatten_weights(table.where(F.col("role") == "encoder")).select(
        "layer", "pos", F.col("w").cast("string").alias("value"),
        (offset + F.col("pos")).cast("long").alias("line"),
    )
    first = table.sparkSession.createDataFrame(
        [(0, 0, header, 0)], "layer int, pos long, value string, line long"
    )
    return first.unionByName(lines)


def export_text(
    spark: SparkSession, encoders: list[np.ndarray], folder: str, name: str,
    part_lines: int = PART_LINES,
) -> str:
    """Write `<folder>/<name>[h1,h2]AE.csv`: layers in order, row-major, bias row first.

    The order of lines is the content. Each line's place in the text follows from its layer's offset, so
    lines are range-partitioned by it and every part is written by its own task: the parts, one after
    another in the order of their names, are the text.
    """
    sizes = [encoders[0].shape[0] - 1] + [w.shape[1] for w in encoders]
    hidden = ",".join(str(k) for k in sizes[1:])
    path = f"{folder.rstrip('/')}/{name}[{hidden}]{FILE_SUFFIX}"
    parts = -(-sum(w.size for w in encoders) // part_lines)
    (
        _lines(model_table(spark, encoders, []), sizes)
        .repartitionByRange(parts, "line").sortWithinPartitions("line").select("value")
        .write.text(path)
    )
    return path


def import_text(spark: SparkSession, path: str) -> list[np.ndarray]:
    """Encoder matrices of an exported text (bounded by the model size).

    Files are read line by line, in parts; the order is that of the files' names, of the parts in a
    file, and of lines within a part. Parts of two exports in one folder are refused.
    """
    literal = re.sub(r"([\[\]{}*?])", r"\\\1", path)
    lines = spark.read.text(literal).where(F.length(F.trim("value")) > 0).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("part"),
        F.monotonically_increasing_id().alias("line"), F.trim("value").alias("value"),
    ).orderBy("file", "part", "line").toArrow()
    if not lines.num_rows:
        raise ValueError(f"no weights at {path}")
    header = lines["value"][0].as_py()
    if not header.endswith(HEADER_SUFFIX):
        raise ValueError(f"unknown header {header!r}")
    sizes = [int(n) for n in header[: -len(HEADER_SUFFIX)].split("_")]
    headers = sum(v.endswith(HEADER_SUFFIX) for v in lines["value"].to_pylist())
    if headers != 1:
        raise ValueError(f"expected one header at {path}, found {headers}")
    flat = lines["value"].slice(1).cast("double").to_numpy()
    cuts = np.cumsum([(n + 1) * k for n, k in zip(sizes, sizes[1:])])
    if len(flat) != cuts[-1]:
        raise ValueError(f"expected {cuts[-1]} weights, found {len(flat)}")
    parts = np.split(flat, cuts[:-1])
    return [p.reshape(n + 1, k) for p, n, k in zip(parts, sizes, sizes[1:])]
