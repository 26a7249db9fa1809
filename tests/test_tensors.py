from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mediaflow.functions import tensors
from mediaflow.functions.hashing import drawn_below, seeded_digest, seeded_uniform

QUICK = settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


def one(spark, values, expression, kind="array<double>"):
    return spark.createDataFrame([(values,)], f"x {kind}").select(expression).first()[0]


@pytest.fixture
def picture():
    return [float(v) for v in range(4 * 4 * 3)]


def test_channel_planes_match_strided_slices(spark, picture):
    planes = np.array(one(spark, picture, tensors.channel_planes("x", 4)))
    x = np.array(picture)
    assert np.array_equal(planes, np.array([x[c::3].reshape(-1, 4) for c in range(3)]))
    deep = np.array(one(spark, picture, tensors.channel_planes("x", 2, leading_axis=True)))
    assert deep.shape == (1, 3, 8, 2)


def test_null_arrays_stay_null(spark):
    for expression in (
        tensors.channel_planes("x", 4),
        tensors.reshape_rows("x", 4),
        tensors.interleaved_to_planar("x", 4, 4),
        tensors.planar_to_interleaved("x", 4, 4),
        tensors.flip_horizontal("x", 4),
        tensors.scale_by("x"),
        tensors.softmax("x"),
        tensors.side_length("x"),
    ):
        assert one(spark, None, expression) is None
    assert one(spark, None, tensors.has_shape("x", 4, 4)) is False


def test_rows_must_come_out_even(spark, picture):
    with pytest.raises(Exception, match="no multiple of 5"):
        one(spark, picture, tensors.reshape_rows("x", 5))
    assert one(spark, [], tensors.reshape_rows("x", 5)) == []


def test_shape_filter_drops_grey_and_alpha_pictures(spark):
    rows = spark.createDataFrame(
        [([0.0] * n if n is not None else None,) for n in (48, 16, 64, None)], "x array<double>"
    )
    assert rows.filter(tensors.has_shape("x", 4, 4)).count() == 1


def test_layouts_are_inverse(spark, picture):
    planar = one(spark, picture, tensors.interleaved_to_planar("x", 4, 4))
    assert np.array_equal(
        np.array(planar), np.array(picture).reshape(4, 4, 3).transpose(2, 0, 1).ravel()
    )
    assert one(spark, planar, tensors.planar_to_interleaved("x", 4, 4)) == picture


@QUICK
@given(st.integers(1, 4), st.integers(1, 5), st.integers(1, 4), st.integers(0, 1000))
def test_flip_twice_is_the_same_picture(spark, height, width, channels, seed):
    x = np.random.default_rng(seed).random(height * width * channels)
    flipped = one(spark, x.tolist(), tensors.flip_horizontal("x", width, channels))
    expected = x.reshape(height, width, channels)[:, ::-1].ravel()
    assert flipped == expected.tolist()
    again = one(spark, flipped, tensors.flip_horizontal("x", width, channels))
    assert again == x.tolist()


@pytest.mark.parametrize("n, channels, side", [(48, 3, 4), (196608, 3, 256), (16, 1, 4), (50, 3, None)])
def test_side_length(spark, n, channels, side):
    assert one(spark, [0.0] * n, tensors.side_length("x", channels)) == side


def test_one_hot_and_back(spark):
    rows = spark.createDataFrame([(0,), (2,), (None,)], "label int")
    encoded = rows.select("label", tensors.one_hot("label", 3).alias("v"))
    found = encoded.select("label", "v", tensors.arg_max("v").alias("back")).collect()
    assert [row["back"] for row in found] == [0, 2, None]
    assert found[1]["v"] == [0.0, 0.0, 1.0]


def test_slices_of_short_lists(spark):
    for values in ([], ["a"], ["a", "b"], ["a", "b", "c"]):
        assert one(spark, values, tensors.without_first("x"), "array<string>") == values[1:]
        assert one(spark, values, tensors.without_ends("x"), "array<string>") == values[1:-1]


def test_float_cast_strict_and_lenient(spark):
    assert one(spark, ["1.5", "2"], tensors.to_floats("x"), "array<string>") == [1.5, 2.0]
    assert one(spark, ["1.5", "bad"], tensors.to_floats("x", False), "array<string>") == [1.5, None]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        one(spark, ["1.5", "bad"], tensors.to_floats("x"), "array<string>")


def test_softmax_of_large_scores(spark):
    assert one(spark, [1000.0, 1000.0], tensors.softmax("x")) == [0.5, 0.5]


@pytest.mark.parametrize("share", [0.0, 1 / 3, 0.8, 0.999999, 1.0])
def test_draws_below_a_share_are_those_of_the_number(spark, share):
    key = F.col("id")
    differ = spark.range(3000).filter(
        drawn_below(seeded_digest(key, 5), share) != (seeded_uniform(key, 5) < share)
    )
    assert differ.count() == 0


def test_uniform_draws_spread_evenly(spark):
    keys = spark.range(4000).select(*[seeded_uniform(F.col("id"), 5, w).alias(f"w{w}") for w in (0, 3)])
    row = keys.agg(F.avg("w0"), F.avg("w3"), F.corr("w0", "w3"), F.min("w0"), F.max("w0")).first()
    assert abs(row[0] - 0.5) < 0.02 and abs(row[1] - 0.5) < 0.02 and abs(row[2]) < 0.06
    assert 0 <= row[3] and row[4] < 1


def test_relu_keeps_null_and_one_hot_refuses_other_labels(spark):
    rows = spark.createDataFrame([(None, 0), (-1.0, 1), (2.0, 2)], "x double, label int")
    assert [row[0] for row in rows.select(tensors.relu("x")).collect()] == [None, 0.0, 2.0]
    assert rows.select(tensors.one_hot("label", 3).alias("v")).collect()[2]["v"] == [0.0, 0.0, 1.0]
    with pytest.raises(Exception, match="outside the classes"):
        rows.select(tensors.one_hot("label", 2)).collect()
