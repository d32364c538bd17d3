"""Greedy layer-wise training: one Spark job per epoch over a block table."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable
from dataclasses import dataclass, fields, replace
from functools import partial

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from layerstack.operators.blocks import LayerSpec, Sums, encode_layer, layer_sums
from layerstack.operators.profile import (
    Profile,
    block_profile,
    check_unit_range,
    checked_profile,
)
from layerstack.operators.rules import Rules
from layerstack.operators.scoring import Stack
from layerstack.operators.sums import COLLECT_BYTES, REDUCE_BYTES, sum_blocks
from layerstack.operators.tables import (
    MODEL_BYTES,
    Shared,
    Source,
    block_rows,
    block_source,
    check_model_bytes,
    element_type,
    heaviest_task,
    is_vector,
    map_blocks,
    pack,
    pack_vectors,
    pass_tasks,
    task_bound,
    vector_block_source,
    vector_source,
)
from layerstack.plans.progress import EpochReport, Progress, State, delete
from layerstack.plans.update import Descent, initial_decoder, initial_encoder, sparsity

log = logging.getLogger("layerstack.training")

# A task this many times larger than it need be makes redistributing worth while.
UNEVEN = 1.5
# Size of a task after redistributing (more where the bound on tasks asks for it).
TASK_BYTES = 8 << 20


@dataclass(frozen=True)
class Settings:
    """Everything `train` needs, already validated by the estimator."""

    features: str | list[str]
    ids: list[str]
    hidden: list[int]
    method: str = "denoising"
    epochs: int = 15
    learning: float = 0.1
    lmbda: float = 1e-10
    beta: float = 1e-10
    sparsity: float = 0.05
    semantics: str = "standard"
    activation: str = "sigmoid"
    tied: bool = False
    corruption: float = 0.5
    seed: int = 0
    scaling: bool = True
    width: int = 0
    storage: str = "auto"
    max_tasks: int = 0
    model_bytes: int = MODEL_BYTES
    progress: str = ""
    progress_epochs: int = 5
    collect_bytes: int = COLLECT_BYTES
    reduce_bytes: int = REDUCE_BYTES

    def identity(self) -> str:
        """The options that decide the result; where and how it is computed is left out."""
        plumbing = {
            "width", "storage", "max_tasks", "model_bytes", "progress", "progress_epochs",
            "collect_bytes", "reduce_bytes",
        }
        return repr({f.name: getattr(self, f.name) for f in fields(self) if f.name not in plumbing})

    def spec(self, layer: int) -> LayerSpec:
        return LayerSpec(
            self.method, Rules.of(self.semantics), self.activation, self.tied, self.corruption,
            self.seed, layer,
        )


class BlockStore:
    """Keeps the block table of the layer in training.

    `table` writes it to the checkpoint folder, which executors share: it survives lost
    executors and cuts the lineage. `cache` keeps it in executor memory and disk. `auto` and
    `source` take the table wherever the session names such a folder, whatever the size.
    """

    def __init__(self, spark: SparkSession, settings: Settings, folder: str | None):
        self._spark = spark
        self._storage = settings.storage
        self._tasks = task_bound(spark, settings.max_tasks)
        if self._storage == "table" and not folder:
            raise ValueError("storage='table' needs a checkpoint folder")
        self._root = None
        if folder and self._storage != "cache":
            self._root = f"{folder.rstrip('/')}/layerstack-{uuid.uuid4().hex}"
        self._held: DataFrame | None = None
        self._path: str | None = None

    def put(self, blocks: DataFrame) -> DataFrame:
        """Store the next block table and let go of the previous one.

        A cached table is rebuilt from what it was made of when an executor is lost, so files
        it came from stay until the end.
        """
        previous, previous_path = self._held, self._path
        if self._root is not None:
            self._path = f"{self._root}/{uuid.uuid4().hex}"
            blocks.write.parquet(self._path)
            self._held = self._spark.read.schema(blocks.schema).parquet(self._path)
            if previous_path is not None:
                self._delete(previous_path)
        else:
            self._path = None
            self._held = blocks.persist(StorageLevel.MEMORY_AND_DISK)
            if previous is not None and previous_path is None:
                self._held.count()
        if previous is not None and previous_path is None:
            previous.unpersist()
        return self._held

    def balance(self, blocks: DataFrame, heaviest: int, rows: int, width: int) -> DataFrame:
        """Redistribute blocks once if one task would hold up every epoch.

        That happens with few or badly split source files, or one source with most of the
        rows. A table whose tasks are even, as large tables mostly are, is not shuffled.
        """
        size = rows * width * 8
        if heaviest * width * 8 <= UNEVEN * max(TASK_BYTES, size / self._tasks):
            return blocks
        pieces = -(-rows // block_rows(width))
        tasks = max(1, min(-(-size // TASK_BYTES), pieces, self._tasks))
        return self.put(blocks.select("rows", "keys", "x").repartition(tasks))

    def close(self) -> None:
        if self._held is not None and self._path is None:
            self._held.unpersist()
        if self._root is not None:
            self._delete(self._root)
        self._held = self._path = None

    def _delete(self, path: str) -> None:
        delete(self._spark, path)


def epoch_sums(
    source: Source, w: np.ndarray, s: np.ndarray, spec: LayerSpec, partials: int,
    settings: Settings,
) -> Sums:
    """One full-batch pass: forward, backward and all sums, in a single job."""
    n, k = w.shape[0] - 1, w.shape[1]
    shared = Shared(source.df.sparkSession, (w, s), [w, s])

    def add(total: np.ndarray, x: np.ndarray, keys: np.ndarray | None) -> None:
        w, s = shared.get()
        layer_sums(x, keys, w, s, spec).add_to(total)

    try:
        total = sum_blocks(
            source, Sums.size(n, k, spec.method == "sparse"), add, partials,
            settings.collect_bytes, settings.reduce_bytes,
        )
    finally:
        shared.close()
    if total is None:
        raise ValueError("the training table has no rows")
    return Sums.unflatten(total, n, k)


def start_layer(n: int, k: int, layer: int, settings: Settings) -> tuple[Descent, Descent]:
    """Encoder and decoder of a layer before its first epoch; refused before they are made if
    they, with their sums over rows, are larger than the model may be."""
    check_model_bytes(8 * Sums.size(n, k, settings.method == "sparse"), settings.model_bytes)
    rules = Rules.of(settings.semantics)
    w = initial_encoder(n, k, rules, settings.seed, layer)
    return (
        Descent(w, settings.learning, settings.lmbda, rules),
        Descent(initial_decoder(w), settings.learning, settings.lmbda, rules),
    )


def train_layer(
    source: Source, rows: int, k: int, layer: int, settings: Settings, state: State | None = None,
    save: Callable[[int, Descent, Descent, list[EpochReport]], None] | None = None,
) -> tuple[np.ndarray, np.ndarray, list[EpochReport]]:
    """Fixed number of epochs on one layer: (encoder, decoder, reports).

    Goes on from a `state` within the layer; `save` gets the state after some epochs and the last.
    """
    encoder, decoder = start_layer(source.width, k, layer, settings)
    if state is not None:
        encoder = replace(encoder, theta=state.encoders[-1], total=state.encoder_total)
        decoder = replace(decoder, theta=state.decoders[-1], total=state.decoder_total)
    size = Sums.size(source.width, k, settings.method == "sparse")
    partials = pass_tasks(
        source.df.sparkSession, source.df.rdd.getNumPartitions(), rows * source.width, size,
        settings.max_tasks,
    )
    reports = []
    for epoch in range(state.epochs if state is not None else 0, settings.epochs):
        spec = replace(settings.spec(layer), epoch=epoch)
        sums = epoch_sums(source, encoder.theta, decoder.theta, spec, partials, settings)
        loss = sums.loss / sums.rows
        gradient = sums.encoder
        if spec.method == "sparse":
            kl, pull = sparsity(
                sums.active, sums.rows, settings.sparsity, settings.beta, spec.rules.beta_power,
                spec.rules.guard,
            )
            loss += settings.beta * kl
            gradient = gradient + sums.lever * pull
        encoder.step(gradient, sums.rows)
        if not settings.tied:
            decoder.step(sums.decoder, sums.rows)
        reports.append(EpochReport(layer, epoch, loss, int(sums.rows)))
        log.info("layer %d epoch %d: J %.9g over %d rows", layer, epoch, loss, sums.rows)
        done = epoch + 1
        if save is not None and (done == settings.epochs or not done % settings.progress_epochs):
            save(done, encoder, decoder, reports)
    s = initial_decoder(encoder.theta) if settings.tied else decoder.theta
    return encoder.theta, s, reports


def _ranges(profile: Profile, settings: Settings):
    if settings.scaling:
        return profile.lo, profile.hi
    check_unit_range(profile)
    return None


def untrained(df: DataFrame, settings: Settings) -> Stack:
    """Start weights and ranges only."""
    profile = checked_profile(df, settings.features, settings.width, settings.max_tasks)
    stack = Stack([], [], [], _ranges(profile, settings))
    n = profile.width
    for layer, k in enumerate(settings.hidden, 1):
        encoder, decoder = start_layer(n, k, layer, settings)
        stack.add(encoder.theta, decoder.theta, settings.spec(layer))
        n = k
    return stack


def checkpoint_folder(spark: SparkSession) -> str | None:
    """The folder that executors share: the session's setting, or what setCheckpointDir was given."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    return given.get() if given.isDefined() else None


def train(df: DataFrame, settings: Settings) -> tuple[Stack, list[EpochReport]]:
    """Train all layers. The source is read once; layer d reads the stored codes of layer
    d - 1, computed once: the layers below never change while d trains.

    With a progress folder, training goes on from the newest state in it: finished layers only
    give codes, and the layer that was in training starts at the epoch after the state's.
    """
    if not settings.epochs:
        return untrained(df, settings), []
    spark = df.sparkSession
    reports: list[EpochReport] = []
    store = BlockStore(spark, settings, checkpoint_folder(spark))
    tasks = task_bound(spark, settings.max_tasks)
    try:
        ids = settings.ids if settings.spec(1).keyed else []
        if settings.storage == "source":
            # Every epoch scans the source's feature and id columns; nothing of it is copied.
            profile = checked_profile(df, settings.features, settings.width, settings.max_tasks)
            ranges = _ranges(profile, settings)
            source = vector_source(df, settings.features, profile.width, ranges, ids)
        elif is_vector(df, settings.features):
            # Sparse vectors stay sparse in store. Ranges would not, so they have a pass of their own.
            profile = checked_profile(df, settings.features, settings.width, settings.max_tasks)
            ranges = _ranges(profile, settings)
            blocks = store.put(pack_vectors(df, settings.features, ids))
            blocks = store.balance(blocks, *heaviest_task(blocks, tasks), profile.width)
            source = vector_block_source(blocks, profile.width, ranges)
        else:
            blocks = store.put(pack(df, settings.features, ids))
            profile = block_profile(blocks, settings.width, settings.max_tasks)
            ranges = _ranges(profile, settings)
            blocks = store.balance(blocks, profile.heaviest, profile.rows, profile.width)
            source = block_source(
                blocks, profile.width, element_type(df, settings.features), ranges
            )
        stack = Stack([], [], [], ranges)
        progress, state = None, None
        if settings.progress:
            progress = Progress(
                spark, settings.progress, settings.identity(), (profile.lo, profile.hi)
            )
            state = progress.newest()
            reports += state.reports if state is not None else []
        for layer, k in enumerate(settings.hidden, 1):
            if state is not None and layer < state.layer:
                w, s = state.encoders[layer - 1], state.decoders[layer - 1]
            else:
                save = None
                if progress is not None:
                    save = partial(_save, progress, stack, list(reports), layer)
                here = state if state is not None and state.layer == layer else None
                w, s, found = train_layer(
                    source, profile.rows, k, layer, settings, here, save
                )
                reports += found
            stack.add(w, s, settings.spec(layer))
            if layer < len(settings.hidden):
                blocks = store.put(_codes(source, w, settings.spec(layer), tasks))
                blocks = store.balance(blocks, *heaviest_task(blocks, tasks), k)
                source = block_source(blocks, k, "f8", None)
    finally:
        store.close()
    return stack, reports


def _save(
    progress: Progress, stack: Stack, earlier: list[EpochReport], layer: int, epochs: int,
    encoder: Descent, decoder: Descent, reports: list[EpochReport],
) -> None:
    """Write the finished layers and the one in training."""
    progress.write(State(
        layer, epochs, [*stack.weights, encoder.theta], [*stack.decoders, decoder.theta],
        encoder.total, decoder.total, earlier + reports,
    ))


def _codes(source: Source, w: np.ndarray, spec: LayerSpec, tasks: int) -> DataFrame:
    """Codes of the layer just finished, as the block table of the next one."""
    shared = Shared(source.df.sparkSession, (w, spec), [w])
    return map_blocks(source, shared, lambda x, value: encode_layer(x, *value), tasks)
