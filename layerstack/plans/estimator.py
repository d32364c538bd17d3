"""The public estimator and model."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import Column, DataFrame, SparkSession

from layerstack.functions.activations import ACTIVATIONS
from layerstack.operators import gradients, matrices, scoring
from layerstack.operators.randoms import keep_threshold
from layerstack.operators.rules import METHODS, OUTSIDE, SEMANTICS, Rules
from layerstack.operators.tables import (
    MODEL_BYTES,
    Shared,
    Source,
    stored_column,
    task_bound,
    vector_source,
)
from layerstack.plans.progress import RANGES_SCHEMA, EpochReport, history_table, read_history
from layerstack.plans.training import Settings, train
from layerstack.sources import weights as files


class _StackParams(Params):
    featuresCol = Param(Params._dummy(), "featuresCol", "array or vector column of features",
                        TypeConverters.toString)
    inputCols = Param(Params._dummy(), "inputCols",
                      "numeric columns to use as features instead of featuresCol",
                      TypeConverters.toListString)
    idCols = Param(Params._dummy(), "idCols",
                   "columns that identify a row; the denoising mask is drawn from them",
                   TypeConverters.toListString)
    outputCol = Param(Params._dummy(), "outputCol", "column for the codes",
                      TypeConverters.toString)
    hidden = Param(Params._dummy(), "hidden", "hidden layer sizes", TypeConverters.toListInt)
    method = Param(Params._dummy(), "method", "regular, denoising or sparse",
                   TypeConverters.toString)
    epochs = Param(Params._dummy(), "epochs", "passes over the table per layer",
                   TypeConverters.toInt)
    learning = Param(Params._dummy(), "learning", "step length", TypeConverters.toFloat)
    lmbda = Param(Params._dummy(), "lmbda", "L2 factor", TypeConverters.toFloat)
    beta = Param(Params._dummy(), "beta", "weight of the sparsity term", TypeConverters.toFloat)
    sparsity = Param(Params._dummy(), "sparsity", "target mean activation",
                     TypeConverters.toFloat)
    semantics = Param(Params._dummy(), "semantics", "standard or reference",
                      TypeConverters.toString)
    activation = Param(Params._dummy(), "activation",
                       "hidden activation: sigmoid, tanh, relu, lrelu or elu",
                       TypeConverters.toString)
    decoder = Param(Params._dummy(), "decoder", "separate or tied", TypeConverters.toString)
    corruption = Param(Params._dummy(), "corruption", "share of features masked in denoising",
                       TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "seed of weights and masks", TypeConverters.toInt)
    scaling = Param(Params._dummy(), "scaling", "scale features to [0, 1] first",
                    TypeConverters.toBoolean)
    numFeatures = Param(Params._dummy(), "numFeatures", "expected width; 0 to infer it",
                        TypeConverters.toInt)
    storage = Param(Params._dummy(), "storage",
                    "where codes are kept while training: auto, cache or table; source keeps no "
                    "copy of the input, which each epoch of the first layer scans",
                    TypeConverters.toString)
    modelBytes = Param(Params._dummy(), "modelBytes",
                       "most bytes of weights, which the driver and every worker hold",
                       TypeConverters.toInt)
    outside = Param(Params._dummy(), "outside",
                    "what a finished model does with values outside the trained range, for which "
                    "cross-entropy has no meaning: keep, clip or error", TypeConverters.toString)
    progressFolder = Param(Params._dummy(), "progressFolder",
                           "shared folder for the state of training, from which a later fit with "
                           "the same options and table goes on; empty for none",
                           TypeConverters.toString)
    progressEpochs = Param(Params._dummy(), "progressEpochs",
                           "write the state after so many epochs, and after each layer",
                           TypeConverters.toInt)
    maxTasks = Param(Params._dummy(), "maxTasks",
                     "most tasks of an epoch job; 0 for four per core (at least 4096)",
                     TypeConverters.toInt)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(
            featuresCol="features", inputCols=[], idCols=[], outputCol="code", hidden=[4],
            method="denoising", epochs=15, learning=0.1, lmbda=1e-10, beta=1e-10,
            sparsity=0.05, semantics="standard", activation="sigmoid", decoder="separate",
            corruption=0.5, seed=0, scaling=True, numFeatures=0, storage="auto", maxTasks=0,
            modelBytes=MODEL_BYTES, outside="keep", progressFolder="", progressEpochs=5,
        )

    def _get(self, name: str):
        return self.getOrDefault(name)

    def _features(self) -> str | list[str]:
        return self._get("inputCols") or self._get("featuresCol")

    def _settings(self) -> Settings:
        one_of = {
            "method": METHODS,
            "semantics": SEMANTICS,
            "activation": tuple(ACTIVATIONS),
            "decoder": ("separate", "tied"),
            "storage": ("auto", "cache", "table", "source"),
            "outside": OUTSIDE,
        }
        for name, allowed in one_of.items():
            if self._get(name) not in allowed:
                raise ValueError(f"{name} must be one of {allowed}, not {self._get(name)!r}")
        hidden = self._get("hidden")
        if not hidden or min(hidden) < 1:
            raise ValueError(f"hidden must list positive layer sizes, not {hidden}")
        if self._get("epochs") < 0:
            raise ValueError("epochs must not be negative")
        if self._get("progressEpochs") < 1:
            raise ValueError("progressEpochs must be positive")
        keep_threshold(self._get("corruption"))
        if not 0 < self._get("sparsity") < 1:
            raise ValueError("sparsity must be between 0 and 1")
        if self._get("activation") != "sigmoid":
            if len(hidden) > 1:
                raise ValueError("only sigmoid codes lie in [0, 1] and can feed another layer")
            if self._get("method") == "sparse":
                raise ValueError("the sparsity term needs sigmoid activations")
        settings = Settings(
            features=self._features(), ids=self._get("idCols"), hidden=hidden,
            method=self._get("method"), epochs=self._get("epochs"),
            learning=self._get("learning"), lmbda=self._get("lmbda"), beta=self._get("beta"),
            sparsity=self._get("sparsity"), semantics=self._get("semantics"),
            activation=self._get("activation"), tied=self._get("decoder") == "tied",
            corruption=self._get("corruption"), seed=self._get("seed"),
            scaling=self._get("scaling"), width=self._get("numFeatures"),
            storage=self._get("storage"), max_tasks=self._get("maxTasks"),
            model_bytes=self._get("modelBytes"), progress=self._get("progressFolder"),
            progress_epochs=self._get("progressEpochs"),
        )
        if settings.spec(1).keyed and not settings.ids and settings.epochs:
            raise ValueError("denoising draws a mask per row: name the id columns in idCols")
        return settings


class StackedAutoencoder(
    Estimator, _StackParams, DefaultParamsWritable, DefaultParamsReadable
):
    """Stack of autoencoders trained layer by layer.

    Options are keyword arguments named as the params above; unknown ones are refused.
    """

    @keyword_only
    def __init__(
        self, *, featuresCol=None, inputCols=None, idCols=None, outputCol=None, hidden=None,
        method=None, epochs=None, learning=None, lmbda=None, beta=None, sparsity=None,
        semantics=None, activation=None, decoder=None, corruption=None, seed=None,
        scaling=None, numFeatures=None, storage=None, maxTasks=None,
        modelBytes=None, outside=None, progressFolder=None, progressEpochs=None,
    ):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> StackedAutoencoderModel:
        stack, reports = train(df, self._settings())
        model = StackedAutoencoderModel()
        self._copyValues(model)
        return model._init(df.sparkSession, stack, reports)


class StackedAutoencoderModel(Model, _StackParams, MLWritable, MLReadable):
    """A trained stack: encodes, reconstructs and scores tables."""

    def _init(
        self, spark: SparkSession, stack: scoring.Stack, reports: list[EpochReport]
    ) -> StackedAutoencoderModel:
        self._spark = spark
        self._stack = stack
        self._reports = reports
        self._shared_stack: Shared | None = None
        return self

    def copy(self, extra=None) -> StackedAutoencoderModel:
        that = super().copy(extra)
        return that._init(self._spark, self._stack, self._reports)

    @property
    def weights(self) -> list[np.ndarray]:
        """Encoder matrices, bias in row 0."""
        return self._stack.weights

    @property
    def decoders(self) -> list[np.ndarray]:
        """Decoder matrices, bias in row 0."""
        return self._stack.decoders

    @property
    def ranges(self) -> tuple[np.ndarray, np.ndarray] | None:
        return self._stack.ranges

    @property
    def history(self) -> DataFrame:
        """`(layer, epoch, loss, m)`; the loss is the one before the epoch's update."""
        return history_table(self._spark, self._reports)

    def weights_df(self) -> DataFrame:
        """The model table: one row per matrix."""
        return matrices.model_table(self._spark, self.weights, self.decoders)

    def _shared(self) -> Shared:
        if self._shared_stack is None:
            stack = replace(self._stack, outside=self._get("outside"))
            self._shared_stack = Shared(self._spark, stack, stack.arrays())
        return self._shared_stack

    def _layer(self, upto: int | None) -> int:
        layer = len(self.weights) if upto is None else upto
        if not 1 <= layer <= len(self.weights):
            raise ValueError(f"the model has layers 1 to {len(self.weights)}, not {layer}")
        return layer

    def _column(self, df: DataFrame) -> Column:
        return stored_column(df, self._features())

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.encode(df, output=self._get("outputCol"))

    def encode(
        self, df: DataFrame, upto: int | None = None, output: str = "code"
    ) -> DataFrame:
        """Add the codes of layer `upto` (the last one by default)."""
        code = scoring.encode_column(self._shared(), self._column(df), self._layer(upto))
        return df.withColumn(output, code)

    def reconstruct(
        self, df: DataFrame, upto: int | None = None, down_to: int = 0,
        output: str = "reconstruction", original_units: bool = False,
    ) -> DataFrame:
        """Add what the decoders make of the codes of layer `upto`.

        `down_to=0` decodes down to the (scaled) features, `upto - 1` only undoes one layer.
        """
        layer = self._layer(upto)
        if not 0 <= down_to < layer:
            raise ValueError(f"down_to must be from 0 to {layer - 1}")
        if original_units and down_to:
            raise ValueError("only features have original units")
        column = scoring.reconstruct_column(
            self._shared(), self._column(df), layer, down_to, original_units
        )
        return df.withColumn(output, column)

    def score(self, df: DataFrame, upto: int | None = None, output: str = "loss") -> DataFrame:
        """Add the cross-entropy of layer `upto` per row."""
        loss = scoring.loss_column(self._shared(), self._column(df), self._layer(upto))
        return df.withColumn(output, loss)

    def _source(self, df: DataFrame, masked: bool) -> Source:
        keyed = masked and self._stack.specs[0].keyed
        ids = self._get("idCols") if keyed else []
        if keyed and not ids:
            raise ValueError("denoising draws a mask per row: name the id columns in idCols")
        return vector_source(
            df, self._features(), self._stack.width, self.ranges, ids, self._get("outside")
        )

    def _shape(self, layer: int) -> tuple[int, int]:
        rows, columns = self.weights[layer - 1].shape
        return rows - 1, columns

    def _tasks(self) -> int:
        return task_bound(self._spark, self._get("maxTasks"))

    def mean_activation(self, df: DataFrame, upto: int | None = None) -> DataFrame:
        """`(unit, p, m)`: mean activation per unit of layer `upto`."""
        return gradients.mean_activation(
            self._source(df, False), self._shared(), self._layer(upto),
            self._tasks(),
        )

    def sparsity_terms(self, df: DataFrame, upto: int | None = None) -> DataFrame:
        """`(unit, p, kl, kl_gradient)` for the model's sparsity target."""
        return gradients.sparsity_terms(
            self.mean_activation(df, upto), self._get("sparsity"), self._get("beta"),
            Rules.of(self._get("semantics")).guard,
        )

    def gradients(self, df: DataFrame, layer: int | None = None) -> DataFrame:
        """`(role, i, j, g, m)`: gradient of a layer's matrices, summed over rows."""
        at = self._layer(layer)
        return gradients.layer_gradients(
            self._source(df, True), self._shared(), at, self._shape(at),
            self._stack.specs[at - 1],
            self._get("sparsity"), self._get("beta"), self._tasks(),
        )

    def check_gradients(
        self, df: DataFrame, layer: int | None = None, eps: float = 1e-3
    ) -> DataFrame:
        """`(role, i, j, analytic, numeric, difference)` for every weight of a layer."""
        at = self._layer(layer)
        return gradients.checked_gradients(
            self._source(df, True), self._shared(), at, self._shape(at),
            self._stack.specs[at - 1],
            self._get("sparsity"), self._get("beta"), self._get("lmbda"), eps, self._tasks(),
        )

    def check_directions(
        self, df: DataFrame, layer: int | None = None, eps: float = 1e-3, directions: int = 8,
        seed: int = 0,
    ) -> DataFrame:
        """`(direction, analytic, numeric, difference)` along random directions of a layer's weights.

        Its cost does not grow with the number of weights, as that of `check_gradients` does.
        """
        if eps <= 0 or directions < 1:
            raise ValueError("eps is above 0, and there are one or more directions")
        at = self._layer(layer)
        return gradients.checked_directions(
            self._source(df, True), self._stack, self._shared(), at, self._get("sparsity"),
            self._get("beta"), self._get("lmbda"), eps, directions, seed, self._tasks(),
        )

    def export_text(self, folder: str, name: str) -> str:
        """Write the encoder weights as text; returns the path."""
        return files.export_text(self._spark, self.weights, folder, name)

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader(cls)


class _ModelWriter(MLWriter):
    def __init__(self, model: StackedAutoencoderModel):
        super().__init__()
        self._model = model

    def saveImpl(self, path: str) -> None:
        model = self._model
        DefaultParamsWriter.saveMetadata(model, path, self.sparkSession)
        model.weights_df().write.parquet(f"{path}/weights")
        model.history.write.parquet(f"{path}/history")
        lo, hi = model.ranges if model.ranges is not None else ([], [])
        rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lo, hi))]
        self.sparkSession.createDataFrame(rows, RANGES_SCHEMA).write.parquet(f"{path}/ranges")


class _ModelReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self._cls = cls

    def load(self, path: str) -> StackedAutoencoderModel:
        spark = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        model = self._cls()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        table = spark.read.schema(matrices.MODEL_SCHEMA).parquet(f"{path}/weights")
        rows = (
            spark.read.schema(RANGES_SCHEMA).parquet(f"{path}/ranges").orderBy("feature")
            .collect()
        )
        ranges = (np.array([r.lo for r in rows]), np.array([r.hi for r in rows]))
        encoders = matrices.matrices_of(table, "encoder")
        settings = model._settings()
        stack = scoring.Stack(
            encoders, matrices.matrices_of(table, "decoder"),
            [settings.spec(n) for n in range(1, len(encoders) + 1)],
            ranges if rows else None,
        )
        return model._init(spark, stack, read_history(spark, f"{path}/history"))


def check_gradients(df: DataFrame, eps: float = 1e-3, **options) -> DataFrame:
    """Gradient check of the start weights on the rows of a table, before any training."""
    return StackedAutoencoder(epochs=0, **options).fit(df).check_gradients(df, 1, eps)


def model_from_weights(
    spark: SparkSession,
    encoders: list[np.ndarray],
    decoders: list[np.ndarray],
    ranges: tuple[np.ndarray, np.ndarray] | None = None,
    **options,
) -> StackedAutoencoderModel:
    """A model of given matrices, to score tables or check gradients with."""
    options["hidden"] = [w.shape[1] for w in encoders]
    estimator = StackedAutoencoder(**options)
    model = StackedAutoencoderModel()
    estimator._copyValues(model)
    settings = estimator._settings()
    specs = [settings.spec(n) for n in range(1, len(encoders) + 1)]
    return model._init(spark, scoring.Stack(list(encoders), list(decoders), specs, ranges), [])
