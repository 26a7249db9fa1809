"""The linear classifier against the same steps in NumPy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, StringIndexer
from pyspark.sql import functions as F

from mediaflow.functions.hashing import seeded_uniform
from mediaflow.functions.tensors import to_vector
from mediaflow.operators.linear import LinearClassifier, LinearClassifierModel


def steps_by_hand(x, y, classes, parts, steps, rate):
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros((classes, x.shape[1]))
    for i in range(steps):
        rows = parts == i % (parts.max() + 1)
        z = x[rows] @ w.T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        w -= rate * (p - np.eye(classes)[y[rows]]).T @ x[rows] / rows.sum()
    return w, (x @ w.T).argmax(axis=1)


@pytest.fixture
def clouds(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 3, 300)
    x = rng.normal(0, 1, (300, 5)) + np.eye(3, 5)[y] * 2
    frame = spark.createDataFrame([(i, row.tolist(), int(label)) for i, (row, label) in enumerate(zip(x, y))], "id int, x array<double>, y int")
    return frame, x, y


@pytest.mark.parametrize("steps, batches", [(1, 1), (7, 1), (5, 2)])
def test_steps_are_those_of_numpy(clouds, steps, batches):
    frame, x, y = clouds
    draws = frame.select("id", seeded_uniform(F.col("id"), 3).alias("u")).orderBy("id").collect()
    parts = np.array([int(row["u"] * batches) for row in draws])
    trainer = LinearClassifier(featuresCol="x", labelCol="y", numClasses=3, steps=steps, rate=0.7, batches=batches, idCol="id", seed=3)
    model = trainer.fit(frame.repartition(5))
    weights, predicted = steps_by_hand(x, y, 3, parts, steps, 0.7)
    assert np.allclose(model.matrix(), weights, atol=1e-12)
    found = model.transform(frame).orderBy("id")
    assert found.columns == ["id", "x", "y", "prediction"]
    assert [row["prediction"] for row in found.collect()] == predicted.tolist()
    assert steps == 1 or (predicted == y).mean() > 0.8


def test_rows_with_gaps_are_not_learned_from(spark, clouds):
    frame, *_ = clouds
    gaps = spark.createDataFrame([(900, None, 1), (901, [0.0] * 5, None)], frame.schema)
    trainer = LinearClassifier(featuresCol="x", labelCol="y", numClasses=3, steps=2)
    assert np.allclose(trainer.fit(frame.unionByName(gaps)).matrix(), trainer.fit(frame).matrix(), atol=1e-12)
    told = trainer.fit(frame).transform(gaps).orderBy("id").collect()
    assert told[0]["prediction"] is None and told[1]["prediction"] in (0.0, 1.0, 2.0)
    even = LinearClassifierModel()._set(featuresCol="x", predictionCol="p", numClasses=2, weights=[0.0] * 12)
    assert {row["p"] for row in even.transform(frame).collect()} == {0.0}


def test_what_cannot_be_trained(clouds):
    frame, *_ = clouds
    with pytest.raises(ValueError, match="weights"):
        LinearClassifier(featuresCol="x", labelCol="y", numClasses=20_000).fit(frame)
    with pytest.raises(ValueError, match="no rows"):
        LinearClassifier(featuresCol="x", labelCol="y").fit(frame.limit(0))
    with pytest.raises(ValueError, match="idCol"):
        LinearClassifier(featuresCol="x", labelCol="y", batches=2).fit(frame)


def test_stages_are_saved_and_loaded(spark, clouds, tmp_path):
    frame, *_ = clouds
    named = frame.select("id", to_vector("x").alias("v"), F.concat(F.lit("class "), F.col("y").cast("string")).alias("c"))
    stages = Pipeline(
        stages=[
            StringIndexer(inputCol="c", outputCol="k"),
            StandardScaler(inputCol="v", outputCol="s", withMean=True),
            LinearClassifier(featuresCol="s", labelCol="k", numClasses=3, steps=10),
        ]
    )
    model = stages.fit(named)
    model.write().save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model"))
    told, told_again = (m.transform(named).orderBy("id").select("k", "prediction").collect() for m in (model, again))
    assert told == told_again
    assert sum(row["k"] == row["prediction"] for row in told) > 240
    plan = model.transform(named)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
