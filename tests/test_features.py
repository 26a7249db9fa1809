from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.feature import StandardScaler
from pyspark.sql import functions as F

from mediaflow.functions.tensors import to_vector
from mediaflow.operators import features
from tests.conftest import rows_of


@pytest.fixture
def points(spark):
    x = np.random.default_rng(1).normal(3.0, 2.0, (200, 10))
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id int, x array<double>"), x


@pytest.mark.parametrize("chunk", [3, 10, 64])
def test_stats_do_not_depend_on_the_chunk(points, chunk):
    df, x = points
    found = features.feature_stats(df, "x", chunk).orderBy("pos").collect()
    assert [row["pos"] for row in found] == list(range(10))
    assert np.allclose([row["mean"] for row in found], x.mean(axis=0))
    assert np.allclose([row["sd"] for row in found], x.std(axis=0, ddof=1))
    assert [row["low"] for row in found] == x.min(axis=0).tolist()
    assert {row["n"] for row in found} == {200}


def test_standardize_equals_spark_ml(points):
    df, x = points
    scaled, model = features.standardize(df, "x", "z")
    assert "__vector" not in scaled.columns
    z = np.array([row["z"] for row in scaled.orderBy("id").collect()])
    assert np.allclose(z, (x - x.mean(axis=0)) / x.std(axis=0, ddof=1))
    vectors = df.withColumn("v", to_vector("x"))
    other = StandardScaler(inputCol="v", outputCol="o", withMean=True).fit(vectors)
    assert np.allclose(other.std.toArray(), model.std.toArray())
    spread, _ = features.standardize(df, "x", "z", with_mean=False)
    z = np.array([row["z"] for row in spread.orderBy("id").collect()])
    assert np.allclose(z, x / x.std(axis=0, ddof=1))


def test_index_by_frequency_then_name(spark):
    rows = spark.createDataFrame([(c,) for c in "bbaaccc"], "c string")
    indexed, _ = features.string_index(rows, "c", "i")
    assert rows_of(indexed.distinct()) == [("a", 1.0), ("b", 2.0), ("c", 0.0)]


def test_input_dim(spark, points):
    assert features.input_dim(points[0], "x") == 10
    uneven = spark.createDataFrame([([1.0],), ([1.0, 2.0],), (None,)], "x array<double>")
    with pytest.raises(ValueError, match="1 to 2"):
        features.input_dim(uneven, "x")
    with pytest.raises(ValueError, match="no arrays"):
        features.input_dim(uneven.filter(F.col("x").isNull()), "x")
    assert rows_of(features.length_range(uneven, "x")) == [(1, 2)]


def test_counts(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "c string")
    assert features.class_count(rows, "c").first()[0] == 2
    assert rows_of(features.label_frequency(rows, "c")) == [("a", 2), ("b", 1), (None, 1)]
