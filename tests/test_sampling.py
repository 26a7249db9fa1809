from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from mediaflow.operators import evaluate, sampling
from tests.conftest import plan_of, rows_of


@pytest.fixture
def keyed(spark):
    return spark.range(5000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))


def test_parts_are_disjoint_and_cover_the_table(keyed):
    train, test = sampling.hash_split(keyed, "k", [0.8, 0.2], 314)
    assert train.intersect(test).count() == 0
    assert rows_of(train.unionAll(test)) == rows_of(keyed)
    assert 0.77 < train.count() / 5000 < 0.83


def test_split_does_not_depend_on_the_layout(keyed):
    weights = {"train": 70, "validation": 20, "test": 10}
    once = sampling.with_split(keyed, "k", weights, 1)
    again = sampling.with_split(keyed.repartition(7), "k", weights, 1)
    assert rows_of(once) == rows_of(again)
    assert "Exchange" not in plan_of(once)
    other = sampling.with_split(keyed, "k", weights, 2)
    assert rows_of(once) != rows_of(other)


def test_random_split_covers_the_table(keyed):
    parts = sampling.random_split(keyed, [0.8, 0.2], 314)
    assert sum(part.count() for part in parts) == 5000


def test_shuffle_is_repeatable_and_global(keyed):
    order = [row["k"] for row in sampling.shuffle_rows(keyed, "k", 7).collect()]
    again = [row["k"] for row in sampling.shuffle_rows(keyed.repartition(5), "k", 7).collect()]
    assert order == again and sorted(order) == list(range(5000)) and order != sorted(order)


def test_shuffle_cuts_through_a_hot_key(spark, uncoalesced):
    hot = spark.range(4000).select(F.when(F.col("id") < 3000, 1).otherwise(F.col("id")).alias("k"))
    placed = sampling.shuffle_rows(hot, "k", 7).withColumn("at", F.spark_partition_id())
    assert placed.filter("k = 1").select("at").distinct().count() > 1


def test_limit_before_and_after_the_filter(spark):
    rows = spark.createDataFrame([(i, None if i < 3 else i) for i in range(10)], "k int, v int")
    passed = F.col("v").isNotNull()
    assert rows_of(sampling.limit_then_filter(rows, 5, passed, "k").select("k")) == [(3,), (4,)]
    assert sampling.filter_then_limit(rows, 5, passed, "k").count() == 5
    assert sampling.limit_then_filter(rows, 5, passed).count() <= 5
    assert "TakeOrderedAndProject" in plan_of(sampling.head_rows(rows, 3, "k"))


@pytest.fixture
def predicted(spark):
    pairs = [(0, 0), (0, 1), (1, 1), (1, 1), (2, 0), (2, 1), (0, 0), (1, 0)]
    return spark.createDataFrame(pairs, "label int, prediction int")


def test_confusion_shows_classes_never_predicted(predicted):
    wide = evaluate.confusion_wide(predicted, [0, 1, 2])
    expected = [(0, 2, 1, 0, 0), (1, 1, 2, 0, 0), (2, 1, 1, 0, 0), (None, 0, 0, 0, 0)]
    assert rows_of(wide) == sorted(expected, key=repr)
    few = rows_of(evaluate.confusion_wide(predicted, [0]))
    assert sum(sum(row[1:]) for row in few) == predicted.count()
    doubles = predicted.withColumn("prediction", F.col("prediction").cast("double"))
    assert rows_of(evaluate.confusion_wide(doubles, [0, 1, 2])) == rows_of(wide)
    assert ("label", "prediction", "n") == tuple(evaluate.confusion_long(predicted).columns)
    assert rows_of(evaluate.confusion_long(predicted))[0] == (0, 0, 2)


def test_accuracy_and_class_metrics(predicted):
    assert evaluate.accuracy(predicted).first()[0] == 0.5
    assert evaluate.overall_precision(predicted).first()["precision"] == 0.5
    found = {row["class"]: row for row in evaluate.precision_recall(predicted, [0, 1, 2]).collect()}
    assert found[0]["precision"] == 0.5 and found[0]["recall"] == pytest.approx(2 / 3)
    assert found[2]["precision"] is None and found[2]["recall"] == 0.0


def test_metrics_agree_with_spark_ml(predicted):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    doubles = predicted.select(F.col("label").cast("double"), F.col("prediction").cast("double"))
    evaluator = MulticlassClassificationEvaluator(metricName="accuracy")
    assert evaluator.evaluate(doubles) == evaluate.accuracy(predicted).first()[0]


def test_losses(spark):
    rows = spark.createDataFrame([(0, [0.9, 0.1]), (1, [0.2, 0.8])], "label int, p array<double>")
    expected = -(F.log(F.lit(0.9)) + F.log(F.lit(0.8))) / 2
    wanted = rows.select(expected).first()[0]
    assert evaluate.categorical_log_loss(rows, "p").first()[0] == pytest.approx(wanted)
    scored = rows.withColumn("s", F.col("p")[1])
    assert evaluate.binary_log_loss(scored, "s").first()[0] == pytest.approx(wanted)
    sure = spark.createDataFrame([(1, [1.0, 0.0])], "label int, p array<double>")
    assert evaluate.categorical_log_loss(sure, "p").first()[0] < 40
