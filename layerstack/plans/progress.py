"""The state of training in a shared folder, from which a later run goes on."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from layerstack.operators.matrices import MODEL_SCHEMA, matrices_of, model_table

HISTORY_SCHEMA = "layer int, epoch int, loss double, m bigint"
RANGES_SCHEMA = "feature int, lo double, hi double"


@dataclass
class EpochReport:
    layer: int
    epoch: int
    loss: float
    rows: int


@dataclass
class State:
    """Finished layers and the last one after some epochs, with the sums its steps depend on."""

    layer: int
    epochs: int
    encoders: list[np.ndarray]
    decoders: list[np.ndarray]
    encoder_total: np.ndarray
    decoder_total: np.ndarray
    reports: list[EpochReport]


def history_table(spark: SparkSession, reports: list[EpochReport]) -> DataFrame:
    rows = [(r.layer, r.epoch, float(r.loss), r.rows) for r in reports]
    return spark.createDataFrame(rows, HISTORY_SCHEMA)


def read_history(spark: SparkSession, path: str) -> list[EpochReport]:
    rows = spark.read.schema(HISTORY_SCHEMA).parquet(path).orderBy("layer", "epoch").collect()
    return [EpochReport(r.layer, r.epoch, r.loss, r.m) for r in rows]


def _located(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(sc._jsc.hadoopConfiguration()), where


def delete(spark: SparkSession, path: str) -> None:
    system, where = _located(spark, path)
    system.delete(where, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder; none where there is no such folder."""
    system, where = _located(spark, path)
    if not system.exists(where):
        return []
    return sorted(s.getPath().getName() for s in system.listStatus(where))


class Progress:
    """Keeps the newest state in a folder.

    A state is complete once its `options` are there, which are written last; the state before it
    goes only then. A folder of other options or of a table with other ranges is refused.
    """

    def __init__(
        self, spark: SparkSession, folder: str, options: str,
        ranges: tuple[np.ndarray, np.ndarray],
    ):
        self._spark = spark
        self._folder = folder.rstrip("/")
        self._options = f"{options} {[r.tolist() for r in ranges]}"

    def _names(self) -> list[str]:
        return [n for n in children(self._spark, self._folder) if n.startswith("state-")]

    def _complete(self, name: str) -> bool:
        return "_SUCCESS" in children(self._spark, f"{self._folder}/{name}/options")

    def write(self, state: State) -> None:
        earlier = self._names()
        name = f"state-{state.layer:06d}-{state.epochs:09d}"
        path = f"{self._folder}/{name}"
        spark = self._spark
        model_table(spark, state.encoders, state.decoders).write.mode("overwrite").parquet(
            f"{path}/weights"
        )
        model_table(spark, [state.encoder_total], [state.decoder_total]).write.mode(
            "overwrite"
        ).parquet(f"{path}/totals")
        history_table(spark, state.reports).write.mode("overwrite").parquet(f"{path}/history")
        spark.createDataFrame([(self._options,)], "options string").write.mode(
            "overwrite"
        ).parquet(f"{path}/options")
        for old in earlier:
            if old != name:
                delete(spark, f"{self._folder}/{old}")

    def newest(self) -> State | None:
        found = [n for n in self._names() if self._complete(n)]
        if not found:
            return None
        path, spark = f"{self._folder}/{found[-1]}", self._spark
        if spark.read.parquet(f"{path}/options").first().options != self._options:
            raise ValueError(f"{self._folder} holds the progress of other options or another table")
        _, layer, epochs = found[-1].split("-")
        weights = spark.read.schema(MODEL_SCHEMA).parquet(f"{path}/weights")
        totals = spark.read.schema(MODEL_SCHEMA).parquet(f"{path}/totals")
        return State(
            int(layer), int(epochs), matrices_of(weights, "encoder"),
            matrices_of(weights, "decoder"), matrices_of(totals, "encoder")[0],
            matrices_of(totals, "decoder")[0], read_history(spark, f"{path}/history"),
        )
