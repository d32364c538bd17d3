"""Layer-wise training of stacks that are larger than the driver or a worker may hold.

Each layer is a table of slices in the checkpoint folder. An epoch is one pass over the rows that gives a
table of sums by slice, a join of the two that averages gradients slice by slice, and a step whose rate
depends on two norms: only the number of rows, the loss and these norms come to the driver, which
hands slices on to tasks one at a time.
"""

from __future__ import annotations

import logging
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerstack.operators.blocks import LayerSpec
from layerstack.operators.profile import block_profile, check_unit_range, checked_profile
from layerstack.operators.slices import (
    HEAD,
    SLICE_BYTES,
    Cut,
    Slices,
    Step,
    averaged_slices,
    long_weights,
    slice_totals,
    sliced_codes,
    sliced_losses,
    start_slices,
    stepped_slices,
)
from layerstack.operators.tables import (
    Source,
    block_source,
    element_type,
    heaviest_task,
    is_vector,
    map_blocks,
    pack,
    pack_vectors,
    pass_tasks,
    stored_column,
    task_bound,
    vector_block_source,
    vector_source,
)
from layerstack.plans.progress import EpochReport, delete, history_table
from layerstack.plans.training import BlockStore, Settings, checkpoint_folder
from layerstack.plans.update import NORM_FLOOR

log = logging.getLogger("layerstack.blocked")


@dataclass(frozen=True)
class BlockedLayer:
    """A layer's slices in a folder."""

    path: str
    cut: Cut
    spec: LayerSpec

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)


class BlockedStack:
    """A trained stack of layers in slices."""

    def __init__(
        self, spark: SparkSession, layers: list[BlockedLayer], ranges, settings: Settings,
        reports: list[EpochReport],
    ):
        self._spark, self.layers, self.ranges, self._settings = spark, layers, ranges, settings
        self._reports = reports

    @property
    def history(self) -> DataFrame:
        """`(layer, epoch, loss, m)`."""
        return history_table(self._spark, self._reports)

    def weights_long(self) -> DataFrame:
        """`(layer, role, row, col, w)` of all layers."""
        parts = [
            long_weights(layer.table(self._spark), layer.cut, at)
            for at, layer in enumerate(self.layers, 1)
        ]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def _passed(self, df: DataFrame, ids: list[str], upto: int, losses: bool) -> DataFrame:
        """Ids with the codes of layer `upto`, or its losses: a pass over the rows for each layer."""
        features, ranges = self._settings.features, self.ranges
        for at, layer in enumerate(self.layers[:upto], 1):
            slices = Slices(layer.table(self._spark), layer.cut)
            df = self._through(df, features, ids, ranges, layer, slices, losses and at == upto)
            features, ranges = "code", None
        return df

    def _through(
        self, df: DataFrame, features, ids: list[str], ranges, layer: BlockedLayer, slices: Slices,
        losses: bool,
    ) -> DataFrame:
        budget, spec, make = self._settings.model_bytes, layer.spec, slices.reader
        read = vector_source(df, features, layer.cut.n, ranges, []).read
        rows = df.select(*[F.col(f"`{c}`") for c in ids], stored_column(df, features).alias("_x"))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
        schema += ", loss double" if losses else ", code array<double>"
        names = [*ids, "loss" if losses else "code"]
        at_x = len(ids)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reader = make(budget)
            for batch in batches:
                done = 0
                only = pa.RecordBatch.from_arrays([batch.column(at_x)], ["x"])
                for x, _ in read(iter([only])):
                    kept = [batch.column(c).slice(done, len(x)) for c in range(at_x)]
                    done += len(x)
                    if losses:
                        made = pa.array(sliced_losses(x, reader, spec))
                    else:
                        y = sliced_codes(x, reader, spec)
                        ends = pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32())
                        made = pa.ListArray.from_arrays(ends, pa.array(y.ravel()))
                    yield pa.RecordBatch.from_arrays([*kept, made], names=names)

        return rows.mapInArrow(run, schema)

    def encode(self, df: DataFrame, ids: list[str], upto: int | None = None) -> DataFrame:
        """Ids and `code`, the codes of layer `upto` (the last one by default).

        Null vectors, and others than the layer's width, end the job.
        """
        return self._passed(df, ids, upto or len(self.layers), False)

    def score(self, df: DataFrame, ids: list[str], upto: int | None = None) -> DataFrame:
        """Ids and `loss`, the cross-entropy of layer `upto`."""
        return self._passed(df, ids, upto or len(self.layers), True)

    def close(self) -> None:
        """Remove the layers' files."""
        for layer in self.layers:
            delete(self._spark, layer.path)


def fit_blocked(df: DataFrame, slice_bytes: int = SLICE_BYTES, **options) -> BlockedStack:
    """Train a stack whose layers are tables of slices; options are the fields of `Settings`.

    model_bytes bounds what a task holds of a layer, and of its gradient, in memory. The session must name a
    checkpoint folder, where the layers stay until `close`. Only the standard semantics can be cut: under the
    reference's every unit's start weights depend on all units before.
    """
    settings = Settings(**options)
    if settings.semantics != "standard":
        raise ValueError("layers in slices follow the standard semantics")
    if settings.spec(1).keyed and not settings.ids:
        raise ValueError("denoising draws a mask per row: name the id columns")
    spark = df.sparkSession
    folder = checkpoint_folder(spark)
    if not folder:
        raise ValueError("layers in slices need a checkpoint folder")
    store = BlockStore(spark, settings, folder)
    tasks = task_bound(spark, settings.max_tasks)
    ids = settings.ids if settings.spec(1).keyed else []
    layers: list[BlockedLayer] = []
    reports: list[EpochReport] = []
    root = f"{folder.rstrip('/')}/layerstack-slices-{uuid.uuid4().hex}"
    try:
        if is_vector(df, settings.features):
            profile = checked_profile(df, settings.features, settings.width, settings.max_tasks)
            blocks = store.put(pack_vectors(df, settings.features, ids))
        else:
            blocks = store.put(pack(df, settings.features, ids))
            profile = block_profile(blocks, settings.width, settings.max_tasks)
        if settings.scaling:
            ranges = profile.lo, profile.hi
        else:
            check_unit_range(profile)
            ranges = None
        blocks = store.balance(blocks, *heaviest_task(blocks, tasks), profile.width)
        if is_vector(df, settings.features):
            source = vector_block_source(blocks, profile.width, ranges)
        else:
            source = block_source(
                blocks, profile.width, element_type(df, settings.features), ranges
            )
        for at, k in enumerate(settings.hidden, 1):
            layer = _train_layer(source, profile.rows, k, at, settings, root, slice_bytes, reports)
            layers.append(layer)
            if at < len(settings.hidden):
                blocks = store.put(_code_blocks(source, layer, settings, tasks))
                blocks = store.balance(blocks, *heaviest_task(blocks, tasks), k)
                source = block_source(blocks, k, "f8", None)
    finally:
        store.close()
    return BlockedStack(spark, layers, ranges, settings, reports)


def _train_layer(
    source: Source, rows: int, k: int, at: int, settings: Settings, root: str, slice_bytes: int,
    reports: list[EpochReport],
) -> BlockedLayer:
    spark = source.df.sparkSession
    cut = Cut.of(source.width, k, slice_bytes)
    sizes = sum(cut.size(j, settings.spec(at)) for j in range(cut.count))
    tasks = pass_tasks(
        spark, source.df.rdd.getNumPartitions(), rows * source.width, sizes, settings.max_tasks
    )
    path = f"{root}/{at}-start"
    start_slices(spark, cut, settings.seed, at).write.parquet(path)
    for epoch in range(settings.epochs):
        spec = replace(settings.spec(at), epoch=epoch)
        then = _epoch(source, path, cut, spec, settings, tasks, f"{root}/{at}-{epoch}", reports)
        delete(spark, path)
        path = then
    return BlockedLayer(path, cut, settings.spec(at))


def _epoch(
    source: Source, path: str, cut: Cut, spec: LayerSpec, settings: Settings, tasks: int, root: str,
    reports: list[EpochReport],
) -> str:
    """One pass and one step; the folder of the next slices."""
    spark = source.df.sparkSession
    table = spark.read.parquet(path)
    slices = Slices(table, cut)
    try:
        slice_totals(source, slices, spec, tasks, settings.model_bytes).write.parquet(f"{root}-sums")
    finally:
        slices.close()
    totals = spark.read.parquet(f"{root}-sums")
    head = totals.where(F.col("chunk") == HEAD).select("v").first()
    if head is None:
        raise ValueError("the training table has no rows")
    rows, loss = np.frombuffer(head.v).tolist()
    step = Step(rows, settings.learning, settings.lmbda, settings.sparsity, settings.beta)
    averaged_slices(table, totals, cut, spec, step).write.parquet(f"{root}-averaged")
    averaged = spark.read.parquet(f"{root}-averaged")
    norms = averaged.agg(
        F.sqrt(F.sum("w_square")).alias("w"), F.sqrt(F.sum("s_square")).alias("s"), F.sum("kl").alias("kl")
    ).first()
    rate = lambda norm: settings.learning / max(norm, NORM_FLOOR)
    stepped_slices(averaged, rate(norms.w), rate(norms.s), cut, spec.tied).write.parquet(root)
    delete(spark, f"{root}-sums")
    delete(spark, f"{root}-averaged")
    loss = loss / rows + (settings.beta * norms.kl if spec.method == "sparse" else 0.0)
    reports.append(EpochReport(spec.layer, spec.epoch, loss, int(rows)))
    log.info("layer %d epoch %d: J %.9g over %d rows", spec.layer, spec.epoch, loss, int(rows))
    return root


def _code_blocks(source: Source, layer: BlockedLayer, settings: Settings, tasks: int) -> DataFrame:
    slices = Slices(layer.table(source.df.sparkSession), layer.cut)
    budget, spec = settings.model_bytes, layer.spec

    class Reader:
        """One reader for each task."""

        def get(self):
            return slices.reader(budget)

    return map_blocks(source, Reader(), lambda x, reader: sliced_codes(x, reader, spec), tasks)
