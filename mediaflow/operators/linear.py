"""A linear classifier trained by gradient steps that are Spark aggregates.

A step scores all rows of its batch, takes the mean of (probability - truth) times the features as one vector aggregate
and moves the weights against it. Rows never leave the executors; what reaches the driver is one vector of
classes x (features + 1) numbers for each step. Weights travel with the plan, so their number is limited.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaflow.functions.hashing import seeded_uniform
from mediaflow.functions.tensors import arg_max, bound_once, softmax
from mediaflow.schemas import require_columns

MOST_WEIGHTS = 100_000


def with_one(df: DataFrame, features_col: str) -> Column:
    """The features as doubles with a 1 behind them, for the bias."""
    column = F.col(features_col)
    values = vector_to_array(column) if isinstance(df.schema[features_col].dataType, VectorUDT) else column
    return F.concat(values.cast("array<double>"), F.array(F.lit(1.0)))


def class_scores(values: Column, weights: list[list[float]]) -> Column:
    """One score for each class; ``weights`` has a row for each, the bias last."""

    def score(row: Column, x: Column) -> Column:
        return F.aggregate(F.zip_with(row, x, lambda w, v: w * v), F.lit(0.0), lambda total, v: total + v)

    table = F.array(*[F.array(*[F.lit(float(w)) for w in row]) for row in weights])
    return bound_once(values, lambda x: F.transform(table, lambda row: score(row, x)))


class LinearClassifierModel(
    Model, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable
):
    """Predicts the class with the largest score, of equal ones the first."""

    numClasses = Param(Params._dummy(), "numClasses", "number of classes", TypeConverters.toInt)
    weights = Param(Params._dummy(), "weights", "scores' weights, class by class", TypeConverters.toListFloat)

    def matrix(self) -> list[list[float]]:
        flat, classes = self.getOrDefault("weights"), self.getOrDefault("numClasses")
        width = len(flat) // classes
        return [flat[i * width : (i + 1) * width] for i in range(classes)]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        scores = class_scores(with_one(dataset, self.getFeaturesCol()), self.matrix())
        scored = dataset.withColumn("__scores", scores)
        return scored.withColumn(self.getPredictionCol(), arg_max("__scores").cast("double")).drop("__scores")


class LinearClassifier(
    Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable
):
    """Softmax regression from zero weights, by ``steps`` gradient steps of size ``rate``.

    With ``batches`` over 1, step i takes the i-th part of the rows, dealt out by a seeded digest of ``idCol``, and
    starts again with the first part after the last. Labels are class numbers from 0; rows with a NULL label or
    features are left out.
    """

    numClasses = LinearClassifierModel.numClasses
    steps = Param(Params._dummy(), "steps", "number of gradient steps", TypeConverters.toInt)
    rate = Param(Params._dummy(), "rate", "step size", TypeConverters.toFloat)
    batches = Param(Params._dummy(), "batches", "parts the rows are dealt into", TypeConverters.toInt)
    idCol = Param(Params._dummy(), "idCol", "column that deals rows into batches", TypeConverters.toString)
    seed = Param(Params._dummy(), "seed", "seed of the deal", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", numClasses=2, steps=1, rate=1.0, batches=1, idCol=None, seed=0):
        super().__init__()
        given = {name: value for name, value in self._input_kwargs.items() if value is not None}
        self._setDefault(predictionCol="prediction", numClasses=2, steps=1, rate=1.0, batches=1, seed=0)
        self._set(**given)

    def _fit(self, dataset: DataFrame) -> LinearClassifierModel:
        features, label = self.getFeaturesCol(), self.getLabelCol()
        require_columns(dataset, [features, label])
        classes, batches = self.getOrDefault("numClasses"), self.getOrDefault("batches")
        if batches > 1 and not self.isDefined("idCol"):
            raise ValueError("batches need idCol")
        part = F.lit(0)
        if batches > 1:
            draw = seeded_uniform(F.col(self.getOrDefault("idCol")), self.getOrDefault("seed"))
            part = F.floor(draw * batches).cast("int")
        rows = dataset.filter(F.col(features).isNotNull() & F.col(label).isNotNull()).select(
            with_one(dataset, features).alias("x"), F.col(label).cast("int").alias("y"), part.alias("part")
        )
        first = rows.select(F.size("x").alias("n")).first()
        if first is None:
            raise ValueError("no rows to train on")
        width = first["n"]
        if classes * width > MOST_WEIGHTS:
            raise ValueError(f"{classes * width} weights; this classifier takes {MOST_WEIGHTS}")
        weights = [[0.0] * width for _ in range(classes)]
        for step in range(self.getOrDefault("steps")):
            slope = self._slope(rows.filter(F.col("part") == step % batches), weights)
            if slope is None:
                continue
            rate = self.getOrDefault("rate")
            weights = [[w - rate * slope[k * width + j] for j, w in enumerate(row)] for k, row in enumerate(weights)]
        model = LinearClassifierModel()
        model._set(
            featuresCol=features,
            predictionCol=self.getPredictionCol(),
            numClasses=classes,
            weights=[w for row in weights for w in row],
        )
        return model

    @staticmethod
    def _slope(rows: DataFrame, weights: list[list[float]]) -> list[float] | None:
        """Mean over the rows of each class's excess probability times each feature; None without rows."""
        shares = bound_once(class_scores(F.col("x"), weights), softmax)
        excess = F.transform(shares, lambda p, k: p - F.when(k == F.col("y"), 1.0).otherwise(0.0))
        # The projection is kept apart, so that scores are not computed anew for each feature.
        told = rows.select("x", excess.alias("excess"))
        product = bound_once(
            F.struct("x", "excess"),
            lambda row: F.flatten(F.transform(row["excess"], lambda e: F.transform(row["x"], lambda v: e * v))),
        )
        mean = Summarizer.metrics("count", "mean").summary(array_to_vector(product))
        found = told.select(mean.alias("s")).select("s.count", "s.mean").first()
        return found["mean"].toArray().tolist() if found["count"] else None
