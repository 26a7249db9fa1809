from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from mediaflow.operators import features, network
from mediaflow.operators.training import AveragedNetwork, AveragedNetworkModel
from mediaflow.schemas import SchemaError
from mediaflow.storage import scratch_path

LINEAR = {
    "input": [2],
    "layers": [{"kind": "dense", "units": 3}, {"kind": "softmax"}],
    "loss": "categorical",
}


def clouds(n: int = 300, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(seed)
    y = draw.integers(0, 3, n)
    centres = np.array([[2.0, 0.0], [-2.0, 1.0], [0.0, -3.0]])
    return centres[y] + draw.normal(size=(n, 2)) * 0.4, y


@pytest.fixture(scope="module")
def points(spark):
    x, y = clouds()
    rows = [(i, x[i].tolist(), int(y[i]), "abc"[y[i]]) for i in range(len(y))]
    return spark.createDataFrame(rows, "id int, features array<double>, label int, name string")


def test_parameter_counts_of_the_three_networks():
    assert network.plan(network.conv_spec(32, 32, 2)).size == 45_218
    assert network.plan(network.conv_spec(32, 32, 1)).size == 45_153
    assert network.plan(network.conv_spec(256, 256, 1)).size == 3_715_169
    hidden = 93 * 512 + 512 + 2 * (512 * 512 + 512) + 512 * 9 + 9
    assert network.plan(network.dense_spec(93, 9)).size == hidden


SPECS = {
    "conv softmax": {
        "input": [7, 6, 3],
        "layers": [
            {"kind": "conv", "filters": 3, "size": 3},
            {"kind": "relu"},
            {"kind": "pool", "size": 2},
            {"kind": "conv", "filters": 2, "size": 2},
            {"kind": "flatten"},
            {"kind": "dense", "units": 4},
            {"kind": "sigmoid"},
            {"kind": "dense", "units": 3},
            {"kind": "softmax"},
        ],
        "loss": "categorical",
    },
    "conv sigmoid, several classes": network.conv_spec(22, 22, 2, filters=(2, 2, 2), units=3, dropout=0),
    "conv sigmoid, one output": network.conv_spec(22, 22, 1, filters=(2, 2, 2), units=3, dropout=0),
    "dense": network.dense_spec(5, 3, (4, 4), dropout=0),
    "softmax within": {
        "input": [4],
        "layers": [
            {"kind": "dense", "units": 3},
            {"kind": "softmax"},
            {"kind": "dense", "units": 2},
            {"kind": "softmax"},
        ],
        "loss": "categorical",
    },
}


@pytest.mark.parametrize("name", SPECS)
def test_gradient_equals_finite_differences(name):
    made = network.plan(SPECS[name])
    draw = np.random.default_rng(3)
    flat = network.initial_weights(made, 1) + draw.normal(size=made.size) * 0.05
    x = draw.normal(size=(4, made.inputs))
    y = draw.integers(0, max(made.outputs, 2), 4)
    outputs, kept = network.forward(made, flat, x)
    gradient = network.backward(made, flat, outputs, y, kept)

    def loss(weights: np.ndarray) -> float:
        return network.losses(made, network.forward(made, weights, x)[0], y).sum()

    for i in draw.choice(made.size, min(made.size, 60), replace=False):
        shift = np.zeros(made.size)
        shift[i] = 1e-6
        slope = (loss(flat + shift) - loss(flat - shift)) / 2e-6
        assert gradient[i] == pytest.approx(slope, rel=1e-4, abs=1e-6)


def test_dropout_keeps_the_mean_and_rests_when_scoring():
    spec = {
        "input": [2000],
        "layers": [{"kind": "dropout", "rate": 0.5}, {"kind": "dense", "units": 2}, {"kind": "softmax"}],
        "loss": "categorical",
    }
    made = network.plan(spec)
    x = np.ones((1, 2000))
    _, kept = network.forward(made, np.zeros(made.size), x, np.random.default_rng(0))
    assert kept[0].mean() == pytest.approx(1.0, abs=0.1) and set(np.unique(kept[0])) == {0.0, 2.0}
    assert network.forward(made, np.zeros(made.size), x)[1][0] is None


@pytest.mark.parametrize("name", sorted(network.RULE_DEFAULTS))
def test_update_rules_go_downhill(name):
    step = network.update_rule(name, {"rate": 0.5} if name != "adadelta" else None)
    w = np.array([3.0, -2.0])
    for _ in range(200):
        w = step(w, 2 * w)
    assert (w**2).sum() < 13 * (0.9 if name == "adadelta" else 0.6)


def test_first_steps_of_the_rules():
    w, g = np.array([1.0]), np.array([0.5])
    assert network.update_rule("sgd")(w, g)[0] == pytest.approx(1 - 0.01 * 0.5)
    assert network.update_rule("adagrad")(w, g)[0] == pytest.approx(1 - 0.01, abs=1e-6)
    assert network.update_rule("adam")(w, g)[0] == pytest.approx(1 - 0.001, abs=1e-6)
    assert network.update_rule("rmsprop")(w, g)[0] == pytest.approx(1 - 0.001 / np.sqrt(0.1), abs=1e-6)


def test_specs_that_do_not_fit():
    bad = [
        {**LINEAR, "loss": "binary"},
        {**LINEAR, "layers": LINEAR["layers"][:1]},
        {**LINEAR, "layers": [{"kind": "dense", "units": 1}, {"kind": "softmax"}]},
        {**LINEAR, "layers": [{"kind": "other"}]},
        network.conv_spec(9, 9),
    ]
    for spec in bad:
        with pytest.raises(network.SpecError):
            network.plan(spec)
    with pytest.raises(network.SpecError):
        network.update_rule("none")
    with pytest.raises(network.SpecError):
        network.update_rule("sgd", {"decay": 1})


def _closed_loop(x: np.ndarray, y: np.ndarray, epochs: int, rate: float) -> np.ndarray:
    made = network.plan(LINEAR)
    flat = network.initial_weights(made, 314)
    for _ in range(epochs):
        outputs, kept = network.forward(made, flat, x)
        flat = flat - rate * network.backward(made, flat, outputs, y, kept) / len(y)
    return flat


@pytest.mark.parametrize("workers", [1, 4, 7])
def test_full_batch_averaging_is_exact(points, workers):
    trainer = AveragedNetwork(
        spec=LINEAR, epochs=3, batchSize=0, numWorkers=workers, optimizerSettings={"rate": 0.3}
    )
    x, y = clouds()
    assert np.allclose(trainer.fit(points).weights, _closed_loop(x, y, 3, 0.3), rtol=0, atol=1e-9)


def test_adaptive_exchange_with_rate_one_is_the_average(points):
    common = {"spec": LINEAR, "epochs": 2, "batchSize": 0, "numWorkers": 2}
    plain = AveragedNetwork(**common).fit(points)
    as_rule = AveragedNetwork(**common, exchange="sgd", exchangeSettings={"rate": 1.0}).fit(points)
    assert np.allclose(plain.weights, as_rule.weights, atol=1e-12)
    moved = AveragedNetwork(**common, exchange="adagrad").fit(points)
    assert not np.allclose(plain.weights, moved.weights)


def test_training_separates_clouds_and_reports_epochs(spark, points):
    trainer = AveragedNetwork(
        spec=network.dense_spec(2, 3, (16,), 0.2),
        optimizer="adam",
        optimizerSettings={"rate": 0.02},
        epochs=6,
        batchSize=16,
        numWorkers=3,
        validationSplit=0.2,
        idCol="id",
        numClasses=3,
    )
    model = trainer.fit(points)
    history = model.history(spark).orderBy("epoch").collect()
    assert [row["epoch"] for row in history] == [1, 2, 3, 4, 5, 6]
    assert all(row["n"] + row["val_n"] == 300 for row in history)
    assert history[-1]["val_accuracy"] > 0.95 and history[-1]["loss"] < history[0]["loss"]
    x, y = clouds(200, seed=9)
    unseen = spark.createDataFrame(
        [(x[i].tolist(), int(y[i])) for i in range(200)], "features array<double>, label int"
    )
    hits = model.transform(unseen).filter(F.col("prediction") == F.col("label")).count()
    assert hits > 190


def test_same_seed_same_weights(points):
    trainer = AveragedNetwork(spec=network.dense_spec(2, 3, (4,), 0.5), epochs=2, numWorkers=2)
    assert np.allclose(trainer.fit(points).weights, trainer.fit(points).weights, atol=1e-12)


def test_convolutional_training_runs(spark):
    made = network.conv_spec(22, 22, 1, filters=(4, 4, 4), units=8, dropout=0)
    draw = np.random.default_rng(0)
    rows = [((draw.random(22 * 22 * 3) * 0.2 + 0.8 * (i % 2)).tolist(), i % 2) for i in range(64)]
    df = spark.createDataFrame(rows, "features array<float>, label int")
    trainer = AveragedNetwork(
        spec=made, epochs=8, batchSize=8, numWorkers=2, optimizer="rmsprop",
        optimizerSettings={"rate": 0.01}, precision="single",
    )
    scored = trainer.fit(df).transform(df)
    assert scored.filter(F.col("prediction") == F.col("label")).count() > 56


def test_bad_training_tables_are_refused(spark, points):
    trainer = AveragedNetwork(spec=LINEAR, epochs=1, numWorkers=1)
    for broken in (
        points.limit(0),
        points.withColumn("label", F.lit(3)),
        points.withColumn("label", F.lit(None).cast("int")),
        points.withColumn("features", F.array(F.lit(1.0))),
        points.drop("label"),
    ):
        with pytest.raises(SchemaError):
            trainer.fit(broken)
    with pytest.raises(network.SpecError):
        AveragedNetwork(spec=LINEAR, numClasses=2).fit(points)
    with pytest.raises(ValueError):
        AveragedNetwork(spec=LINEAR, validationSplit=1.0).fit(points)


def test_setters_and_epoch_lines(points, capsys):
    trainer = (
        AveragedNetwork()
        .setSpec(LINEAR)
        .setFeaturesCol("features")
        .setLabelCol("label")
        .setPredictionCol("guess")
        .setOptimizer("adagrad", rate=0.1)
        .setExchange("adadelta", rate=0.5)
        .setNumClasses(3)
        .setNumWorkers(1)
        .setEpochs(2)
        .setBatchSize(128)
        .setValidationSplit(0.15)
        .setVerbosity(1)
    )
    assert "guess" in trainer.fit(points).transform(points).columns
    assert capsys.readouterr().out.count("epoch") == 2


def test_slices_bound_the_layers():
    made = network.plan(network.conv_spec(256, 256, 1))
    assert made.widest == 125 * 125 * 288
    parts = network.slices(made, 10)
    assert len(parts) == 4 and parts[-1].stop >= 10
    assert len(network.slices(network.plan(LINEAR), 1000)) == 4


def test_scoring_refuses_other_widths(spark):
    model = AveragedNetworkModel.of(LINEAR, np.zeros(9))
    rows = spark.createDataFrame([([1.0],), ([1.0, 2.0, 3.0],)], "features array<double>").coalesce(1)
    with pytest.raises(Exception, match="not of 2"):
        model.transform(rows).collect()


def test_null_features_predict_null(spark):
    model = AveragedNetworkModel.of(LINEAR, np.zeros(9), scoresCol="scores")
    rows = spark.createDataFrame([([1.0, 2.0],), (None,)], "features array<double>")
    found = model.transform(rows).collect()
    assert found[0]["scores"] == pytest.approx([1 / 3] * 3)
    assert found[1]["prediction"] is None and found[1]["scores"] is None


def test_scoring_calls_once_per_row_under_a_filter(points):
    model = AveragedNetworkModel.of(LINEAR, np.arange(9.0))
    kept = model.transform(points).filter("prediction = 2")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_stages_fit_save_and_load(spark, points):
    from mediaflow.functions.tensors import to_vector

    rows = points.select(to_vector("features").alias("features"), "name")
    stages = Pipeline(
        stages=[
            features.string_indexer("name", "index"),
            features.standard_scaler("features", "scaled"),
            AveragedNetwork(
                spec=network.dense_spec(2, 3, (8,), 0.0), featuresCol="scaled", labelCol="index",
                optimizer="adam", optimizerSettings={"rate": 0.05}, epochs=4, numWorkers=2,
            ),
        ]
    )
    fitted = stages.fit(rows)
    scored = fitted.transform(rows)
    assert scored.filter(F.col("index") == F.col("prediction")).count() > 285
    path = scratch_path(spark, "stages")
    fitted.save(path)
    again = PipelineModel.load(path)
    assert np.array_equal(again.stages[2].weights, fitted.stages[2].weights)
    assert again.stages[2].history(spark).count() == 4
    assert again.transform(rows).filter(F.col("index") == F.col("prediction")).count() > 285


def test_estimator_save_and_load(spark):
    trainer = AveragedNetwork(spec=LINEAR, optimizer="adagrad", optimizerSettings={"rate": 0.1})
    path = scratch_path(spark, "estimator")
    trainer.save(path)
    again = AveragedNetwork.load(path)
    assert again.getOrDefault("spec") == trainer.getOrDefault("spec")
    assert again.getOrDefault("optimizer") == "adagrad"


@pytest.mark.parametrize("given, before, after", [(3, 7, 3), (0, 2, 4), (0, 9, 4)])
def test_rows_are_dealt_out_to_workers(points, given, before, after):
    trainer = AveragedNetwork(spec=LINEAR, numWorkers=given)
    dealt = trainer._dealt_out(points.repartition(before).withColumn("deal", F.xxhash64("features")))
    assert dealt.rdd.getNumPartitions() == after
    assert "deal" not in dealt.columns


@pytest.mark.parametrize("partitions", [4, 32])
def test_sorted_rows_train_as_well_in_any_number_of_partitions(spark, partitions):
    draw = np.random.default_rng(5)
    centres = np.array([[3.0, 0.0], [-3.0, 0.0], [0.0, 3.0]])
    rows = [(i, (centres[i % 3] + draw.normal(0, 0.4, 2)).tolist(), i % 3) for i in range(1500)]
    rows = spark.createDataFrame(rows, "id int, features array<double>, label int")
    rows = rows.repartitionByRange(partitions, "label").sortWithinPartitions("label")
    spec = network.dense_spec(2, 3, (8,), 0.0)
    trainer = AveragedNetwork(spec=spec, epochs=6, batchSize=16, optimizerSettings={"rate": 0.1}, idCol="id")
    scored = trainer.fit(rows).transform(rows)
    assert scored.filter(F.col("label") == F.col("prediction")).count() / 1500 >= 0.98


def test_weight_table(spark):
    model = AveragedNetworkModel.of(LINEAR, np.arange(9.0))
    rows = model.weight_table(spark).orderBy("layer", "pos").collect()
    assert [row["weight"] for row in rows] == list(range(9))
    wide = network.dense_spec(100, 3, (90,), 0)
    made = network.plan(wide)
    rows = AveragedNetworkModel.of(wide, np.arange(made.size)).weight_table(spark).collect()
    first = sorted((row["pos"], row["weight"]) for row in rows if row["layer"] == 0)
    assert first == [(i, float(i)) for i in range(9090)]
    assert len(rows) == made.size
