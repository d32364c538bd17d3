"""Scaling, validation and corruption of feature tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerstack.operators.blocks import features_block, scale_block
from layerstack.operators.profile import checked_profile
from layerstack.operators.randoms import fixed_mask, hash_mask, keep_threshold
from layerstack.operators.tables import feature_column, task_bound
from layerstack.operators.vectors import keyed_vector_udf, vector_udf


def scale_minmax(
    df: DataFrame,
    features: str | list[str],
    output: str = "scaled",
    ranges: tuple[np.ndarray, np.ndarray] | None = None,
) -> DataFrame:
    """Add features scaled to [0, 1]; a constant feature becomes 0.

    Without `ranges`, one pass over the table finds them. Rows themselves are scaled lazily.
    """
    if ranges is None:
        profile = checked_profile(df, features)
        ranges = (profile.lo, profile.hi)
    width = len(ranges[0])

    def scaled(column: pa.Array) -> np.ndarray:
        return scale_block(features_block(column, width), ranges)

    return df.withColumn(output, vector_udf(scaled, feature_column(df, features)))


def validate_features(
    df: DataFrame, features: str | list[str], low: float = 0.0, high: float = 1.0
) -> DataFrame:
    """One row of counts: `rows, null_rows, min_width, max_width, bad_values, outside`.

    `bad_values` are nulls and NaN, `outside` are values below `low` or above `high`.
    """
    names = ["rows", "null_rows", "min_width", "max_width", "bad_values", "outside"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    arrow = pa.schema(list(zip(names, types)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            nulls = column.null_count
            rows, column = len(column), column.drop_null() if nulls else column
            sizes = np.diff(column.offsets.to_numpy())
            values = column.flatten().to_numpy(zero_copy_only=False)
            counts = [
                rows, nulls, int(sizes.min()) if len(sizes) else None,
                int(sizes.max()) if len(sizes) else None, int(np.isnan(values).sum()),
                int(((values < low) | (values > high)).sum()),
            ]
            yield pa.RecordBatch.from_pylist([dict(zip(names, counts))], schema=arrow)

    schema = "rows bigint, null_rows bigint, min_width int, max_width int, bad_values bigint, " \
             "outside bigint"
    parts = df.select(feature_column(df, features).alias("x")).coalesce(
        task_bound(df.sparkSession)
    ).mapInArrow(run, schema)
    total = {n: F.coalesce(F.sum(n), F.lit(0).cast("bigint")).alias(n) for n in names}
    total["min_width"] = F.min("min_width").alias("min_width")
    total["max_width"] = F.max("max_width").alias("max_width")
    return parts.agg(*[total[n] for n in names])


def corrupt(
    df: DataFrame,
    features: str | list[str],
    ids: list[str] | None = None,
    drop: float = 0.5,
    seed: int = 0,
    layer: int = 1,
    epoch: int = 0,
    output: str = "corrupted",
    width: int = 0,
) -> DataFrame:
    """Add a copy of the features with a share `drop` of them set to 0.

    With `width`, a vector of another width is refused; without, those of one Arrow batch must
    agree. Null vectors stay null.

    The mask is a hash of the row's id columns, the feature position, layer, epoch and seed:
    the same whatever the partitioning, and the one denoising training uses.
    """
    if not ids:
        raise ValueError("name the id columns: the mask is drawn per row")
    keep_threshold(drop)

    def masked(column: pa.Array, key: pa.Array) -> np.ndarray:
        n = width or (len(column[0]) if len(column) else 0)
        keys = key.to_numpy(zero_copy_only=False)
        return features_block(column, n) * hash_mask(keys, n, drop, layer, epoch, seed)

    x = feature_column(df, features)
    return df.withColumn(output, keyed_vector_udf(masked, x, F.xxhash64(*ids)))


def corrupt_fixed(
    df: DataFrame, features: str | list[str], width: int, output: str = "corrupted"
) -> DataFrame:
    """Add a copy of the features under the one fixed mask of the reference semantics."""

    def masked(column: pa.Array) -> np.ndarray:
        return features_block(column, width) * fixed_mask(width)

    return df.withColumn(output, vector_udf(masked, feature_column(df, features)))
