"""Data-parallel training of a network over the partitions of a DataFrame, as an ML estimator.

One epoch is one Spark job. Every partition starts from the same weights, streams its rows once in
mini-batches and emits its weights in pieces together with its row count; the pieces are averaged
on Spark, weighted by rows, and only the averaged weights and a handful of sums reach the driver.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed
from pyspark.ml.stat import Summarizer
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
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaflow.functions.hashing import drawn_below, seeded_digest
from mediaflow.operators import network
from mediaflow.operators.epoch import PIECE, SUMS, EpochTask, scored
from mediaflow.schemas import SchemaError, require_columns
from mediaflow.shipping import ship_package
from mediaflow.storage import shared_dir

PIECE_SCHEMA = (
    "piece int, weights array<double>, n bigint, loss double, hits bigint, "
    "val_n bigint, val_loss double, val_hits bigint"
)
HISTORY_SCHEMA = (
    "epoch int, n bigint, loss double, accuracy double, "
    "val_n bigint, val_loss double, val_accuracy double"
)


def as_array(df: DataFrame, column: str) -> Column:
    """The column as an array, also where it holds vectors."""
    if isinstance(df.schema[column].dataType, VectorUDT):
        return vector_to_array(F.col(column))
    return F.col(column)


def _run_epoch(rows: DataFrame, made, flat: np.ndarray, settings: dict, epoch: int):
    """One job: the row-weighted mean of the partitions' weights, and the summed metrics."""
    ship_package(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(flat)
    pieces = rows.mapInArrow(EpochTask(made, shared, settings, epoch), PIECE_SCHEMA)
    mean = Summarizer.mean(F.col("vector"), F.col("n").cast("double"))
    merged = (
        pieces.withColumn("vector", array_to_vector("weights"))
        .groupBy("piece")
        .agg(vector_to_array(mean).alias("weights"), *[F.sum(name).alias(name) for name in SUMS])
        .collect()
    )
    shared.destroy()
    merged.sort(key=lambda row: row["piece"])
    averaged = np.concatenate([np.asarray(row["weights"]) for row in merged])
    return averaged, merged[0].asDict()


def _measure(rows: DataFrame, made, flat: np.ndarray, settings: dict) -> dict:
    """One job: the metrics of fixed weights."""
    shared = rows.sparkSession.sparkContext.broadcast(flat)
    task = EpochTask(made, shared, {**settings, "train": False}, 0)
    sums = rows.mapInArrow(task, PIECE_SCHEMA).agg(*[F.sum(name).alias(name) for name in SUMS])
    found = sums.first().asDict()
    shared.destroy()
    return found


class _NetworkParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed):
    spec = Param(Params._dummy(), "spec", "network description as JSON", TypeConverters.toString)
    scoresCol = Param(
        Params._dummy(), "scoresCol", "column for the outputs; empty for none",
        TypeConverters.toString,
    )
    optimizer = Param(
        Params._dummy(), "optimizer", "update rule within a partition", TypeConverters.toString
    )
    optimizerSettings = Param(
        Params._dummy(), "optimizerSettings", "its settings as JSON", TypeConverters.toString
    )
    exchange = Param(
        Params._dummy(), "exchange",
        "how averaged weights are taken over: average, or an update rule fed with the difference",
        TypeConverters.toString,
    )
    exchangeSettings = Param(
        Params._dummy(), "exchangeSettings", "its settings as JSON", TypeConverters.toString
    )
    numClasses = Param(
        Params._dummy(), "numClasses", "number of classes; 0 takes it from the spec",
        TypeConverters.toInt,
    )
    numWorkers = Param(
        Params._dummy(), "numWorkers", "partitions to train on; 0 for one per core of the cluster",
        TypeConverters.toInt,
    )
    epochs = Param(Params._dummy(), "epochs", "passes over the data", TypeConverters.toInt)
    batchSize = Param(
        Params._dummy(), "batchSize", "rows per step; 0 for one step per partition and epoch",
        TypeConverters.toInt,
    )
    validationSplit = Param(
        Params._dummy(), "validationSplit", "share of rows held out", TypeConverters.toFloat
    )
    validationIndicatorCol = Param(
        Params._dummy(), "validationIndicatorCol",
        "boolean column, true for rows that only measure; instead of validationSplit, empty for none",
        TypeConverters.toString,
    )
    maxWeights = Param(
        Params._dummy(), "maxWeights",
        "largest number of weights, since their average passes the driver (8 bytes each)",
        TypeConverters.toInt,
    )
    idCol = Param(
        Params._dummy(), "idCol",
        "column that settles which rows are held out; empty for the features themselves",
        TypeConverters.toString,
    )
    initial = Param(
        Params._dummy(), "initial", "start from random or zero weights", TypeConverters.toString
    )
    precision = Param(
        Params._dummy(), "precision", "single or double arithmetic", TypeConverters.toString
    )
    verbosity = Param(
        Params._dummy(), "verbosity", "1 prints a line per epoch", TypeConverters.toInt
    )

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(
            featuresCol="features",
            labelCol="label",
            predictionCol="prediction",
            scoresCol="",
            optimizer="sgd",
            optimizerSettings="{}",
            exchange="average",
            exchangeSettings="{}",
            numClasses=0,
            numWorkers=0,
            epochs=20,
            batchSize=32,
            validationSplit=0.0,
            validationIndicatorCol="",
            maxWeights=64 * 1024 * 1024,
            idCol="",
            initial="random",
            precision="double",
            verbosity=0,
            seed=314,
        )

    def _plan(self):
        return network.plan(json.loads(self.getOrDefault("spec")))


class AveragedNetwork(Estimator, _NetworkParams, DefaultParamsReadable, DefaultParamsWritable):
    """Trains a network by synchronous averaging over partitions.

    Rows of a held-out share measure loss and accuracy after every epoch. Rows with one id, or with
    the same features where no id is named, are held out together or not at all.
    """

    @keyword_only
    def __init__(
        self,
        *,
        spec=None,
        featuresCol=None,
        labelCol=None,
        predictionCol=None,
        scoresCol=None,
        optimizer=None,
        optimizerSettings=None,
        exchange=None,
        exchangeSettings=None,
        numClasses=None,
        numWorkers=None,
        epochs=None,
        batchSize=None,
        validationSplit=None,
        validationIndicatorCol=None,
        maxWeights=None,
        idCol=None,
        initial=None,
        precision=None,
        verbosity=None,
        seed=None,
    ) -> None:
        super().__init__()
        given = {k: v for k, v in self._input_kwargs.items() if v is not None}
        self.setParams(**given)

    def setParams(self, **params) -> AveragedNetwork:
        """Set parameters by name; descriptions and settings may be dictionaries."""
        for name in ("spec", "optimizerSettings", "exchangeSettings"):
            if isinstance(params.get(name), dict):
                params[name] = json.dumps(params[name])
        return self._set(**params)

    def setSpec(self, value: dict | str) -> AveragedNetwork:
        return self.setParams(spec=value)

    def setFeaturesCol(self, value: str) -> AveragedNetwork:
        return self._set(featuresCol=value)

    def setLabelCol(self, value: str) -> AveragedNetwork:
        return self._set(labelCol=value)

    def setPredictionCol(self, value: str) -> AveragedNetwork:
        return self._set(predictionCol=value)

    def setOptimizer(self, value: str, **settings: float) -> AveragedNetwork:
        return self.setParams(optimizer=value, optimizerSettings=settings)

    def setExchange(self, value: str, **settings: float) -> AveragedNetwork:
        return self.setParams(exchange=value, exchangeSettings=settings)

    def setNumClasses(self, value: int) -> AveragedNetwork:
        return self._set(numClasses=value)

    def setNumWorkers(self, value: int) -> AveragedNetwork:
        return self._set(numWorkers=value)

    def setEpochs(self, value: int) -> AveragedNetwork:
        return self._set(epochs=value)

    def setBatchSize(self, value: int) -> AveragedNetwork:
        return self._set(batchSize=value)

    def setValidationSplit(self, value: float) -> AveragedNetwork:
        return self._set(validationSplit=value)

    def setVerbosity(self, value: int) -> AveragedNetwork:
        return self._set(verbosity=value)

    def _fit(self, dataset: DataFrame) -> AveragedNetworkModel:
        get = self.getOrDefault
        made = self._plan()
        if made.size > get("maxWeights"):
            raise network.SpecError(f"{made.size} weights; at most {get('maxWeights')} are exchanged")
        classes = 2 if made.spec["loss"] == "binary" else made.outputs
        if get("numClasses") not in (0, classes):
            raise network.SpecError(
                f"the network tells {classes} classes apart, the data have {get('numClasses')}"
            )
        rows = self._training_rows(dataset)
        shared_dir(rows.sparkSession)
        rows = self._dealt_out(rows)
        # Every epoch reads these rows again: written once, they outlive lost executors.
        rows = rows.checkpoint(eager=True)
        self._check(rows, made, classes)
        flat = (
            np.zeros(made.size)
            if get("initial") == "zero"
            else network.initial_weights(made, get("seed"))
        )
        settings = {
            "optimizer": get("optimizer"),
            "optimizer_settings": json.loads(get("optimizerSettings")),
            "batch_size": get("batchSize"),
            "precision": get("precision"),
            "seed": get("seed"),
            "train": True,
        }
        exchange = None
        if get("exchange") != "average":
            exchange = network.update_rule(
                get("exchange"), json.loads(get("exchangeSettings"))
            )
        history: list[list] = []
        for epoch in range(1, get("epochs") + 1):
            averaged, sums = _run_epoch(rows, made, flat, settings, epoch)
            if not np.isfinite(averaged).all():
                raise FloatingPointError(f"weights are not finite after epoch {epoch}")
            self._note_validation(history, sums)
            flat = averaged if exchange is None else exchange(flat, flat - averaged)
            history.append(
                [epoch, sums["n"], _ratio(sums["loss"], sums["n"]), _ratio(sums["hits"], sums["n"])]
                + [0, None, None]
            )
            if get("verbosity"):
                print(f"epoch {epoch}: loss {history[-1][2]}, accuracy {history[-1][3]}")
        if history and (get("validationSplit") > 0 or get("validationIndicatorCol")):
            self._note_validation(history, _measure(rows.filter("held_out"), made, flat, settings))
        model = AveragedNetworkModel(flat, [tuple(row) for row in history])
        return self._copyValues(model)

    def _training_rows(self, dataset: DataFrame) -> DataFrame:
        get = self.getOrDefault
        require_columns(dataset, [get("featuresCol"), get("labelCol")])
        features = as_array(dataset, get("featuresCol"))
        share = get("validationSplit")
        if not 0 <= share < 1:
            raise ValueError(f"validationSplit must be in [0, 1), not {share}")
        indicator = get("validationIndicatorCol")
        if share > 0 and indicator:
            raise ValueError("give validationSplit or validationIndicatorCol, not both")
        if indicator:
            require_columns(dataset, [indicator])
            held_out: Column = F.coalesce(F.col(indicator), F.lit(False))
        elif share > 0:
            source = F.col(get("idCol")) if get("idCol") else features.cast("string")
            held_out = drawn_below(seeded_digest(source, get("seed")), share)
        else:
            held_out = F.lit(False)
        # Without an id, copies of a row would all come to one worker: a draw of their own parts them.
        deal = [F.col(get("idCol"))] if get("idCol") else [features, F.rand(get("seed"))]
        return dataset.select(
            features.alias("features"),
            F.col(get("labelCol")).cast("int").alias("label"),
            held_out.alias("held_out"),
            F.xxhash64(F.lit(get("seed")), *deal).alias("deal"),
        )

    def _dealt_out(self, rows: DataFrame) -> DataFrame:
        """One partition per worker, by default one per core, in a random order that the seed settles.

        However the input lies, sorted or not, in few partitions or many, every worker gets a fair share
        of all of it.
        """
        workers = self.getOrDefault("numWorkers") or rows.sparkSession.sparkContext.defaultParallelism
        return rows.repartition(workers, "deal").sortWithinPartitions("deal").drop("deal")

    @staticmethod
    def _check(rows: DataFrame, made, classes: int) -> None:
        width = F.size("features")
        missing = F.col("features").isNull() | F.col("label").isNull()
        found = rows.agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(missing).alias("missing"),
            F.count_if(~F.col("held_out")).alias("kept"),
            F.min(width).alias("narrow"),
            F.max(width).alias("wide"),
            F.min("label").alias("low"),
            F.max("label").alias("high"),
        ).first()
        if found["kept"] == 0:
            raise SchemaError("no rows to train on")
        if found["missing"]:
            raise SchemaError(f"{found['missing']} rows lack features or label; drop them first")
        if (found["narrow"], found["wide"]) != (made.inputs, made.inputs):
            raise SchemaError(
                f"features have {found['narrow']} to {found['wide']} values, "
                f"the network takes {made.inputs}"
            )
        if found["low"] < 0 or found["high"] >= classes:
            raise SchemaError(
                f"labels run from {found['low']} to {found['high']}, the network has {classes} classes"
            )

    @staticmethod
    def _note_validation(history: list[list], sums: dict) -> None:
        if history and sums["val_n"]:
            history[-1][4:] = [
                sums["val_n"],
                sums["val_loss"] / sums["val_n"],
                sums["val_hits"] / sums["val_n"],
            ]


def _ratio(total: float, n: int) -> float | None:
    return total / n if n else None


class AveragedNetworkModel(Model, _NetworkParams, MLReadable, MLWritable):
    """A trained network: appends the predicted class, and the outputs where a column is named."""

    def __init__(self, weights: np.ndarray | None = None, history: list[tuple] | None = None) -> None:
        super().__init__()
        self.weights = np.zeros(0) if weights is None else np.asarray(weights, dtype=np.float64)
        self._history = history or []

    @classmethod
    def of(cls, spec: dict, weights: np.ndarray, **params) -> AveragedNetworkModel:
        """A model from given weights, without training."""
        made = network.plan(spec)
        if len(weights) != made.size:
            raise network.SpecError(f"{len(weights)} weights given, {made.size} needed")
        return cls(weights)._set(spec=json.dumps(spec), **params)

    def history(self, spark: SparkSession) -> DataFrame:
        """One row per epoch: rows, loss and accuracy, in training and on the held-out rows."""
        return spark.createDataFrame(self._history, HISTORY_SCHEMA)

    def weight_table(self, spark: SparkSession) -> DataFrame:
        """Weights as rows (layer, pos, weight)."""
        pieces = [
            (layer, at - start, self.weights[at : min(at + PIECE, bias + shape[1])].tolist())
            for layer, (start, shape, bias) in enumerate(self._plan().slots)
            if shape
            for at in range(start, bias + shape[1], PIECE)
        ]
        rows = spark.createDataFrame(pieces, "layer int, start int, weights array<double>")
        weights = rows.select("layer", "start", F.posexplode("weights").alias("at", "weight"))
        return weights.select("layer", (F.col("start") + F.col("at")).alias("pos"), "weight")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        get = self.getOrDefault
        require_columns(dataset, [get("featuresCol")])
        made = self._plan()
        dtype = "float32" if get("precision") == "single" else "float64"
        ship_package(dataset.sparkSession)
        shared = dataset.sparkSession.sparkContext.broadcast(self.weights)

        def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            flat = shared.value.astype(dtype)
            for values in batches:
                yield scored(made, flat, values, dtype, with_scores)

        with_scores = bool(get("scoresCol"))
        kind = T.StructType([T.StructField("prediction", T.DoubleType())])
        if with_scores:
            kind.add("scores", T.ArrayType(T.DoubleType()))
        # Not deterministic to Catalyst, so that a later filter cannot make it run twice.
        scorer = F.arrow_udf(score, kind).asNondeterministic()
        features = as_array(dataset, get("featuresCol"))
        out = dataset.withColumn("__scored", scorer(features))
        out = out.withColumn(get("predictionCol"), F.col("__scored.prediction"))
        if get("scoresCol"):
            out = out.withColumn(get("scoresCol"), F.col("__scored.scores"))
        return out.drop("__scored")

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader(cls)


class _ModelWriter(MLWriter):
    def __init__(self, instance: AveragedNetworkModel) -> None:
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        spark = self.sparkSession
        DefaultParamsWriter.saveMetadata(self.instance, path, spark)
        flat = self.instance.weights
        pieces = [
            (i, flat[at : at + PIECE].tolist()) for i, at in enumerate(range(0, len(flat), PIECE))
        ]
        spark.createDataFrame(pieces, "piece int, weights array<double>").write.parquet(
            f"{path}/weights"
        )
        self.instance.history(spark).write.parquet(f"{path}/history")


class _ModelReader(MLReader):
    def __init__(self, cls: type[AveragedNetworkModel]) -> None:
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> AveragedNetworkModel:
        spark = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        pieces = spark.read.parquet(f"{path}/weights").orderBy("piece").collect()
        flat = np.concatenate([np.asarray(row["weights"]) for row in pieces])
        history = spark.read.parquet(f"{path}/history").orderBy("epoch").collect()
        model = self.cls(flat, [tuple(row) for row in history])
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
