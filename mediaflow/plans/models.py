"""Queries that train and apply models."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaflow.functions.tensors import scale_by, to_vector
from mediaflow.operators import features, images, network
from mediaflow.operators.linear import LinearClassifier, class_scores, with_one
from mediaflow.operators.sampling import hash_split
from mediaflow.operators.training import AveragedNetwork, AveragedNetworkModel
from mediaflow.plans.arrays import CLASSES, PIXELS_SQL, SIDE, pixel_rows
from mediaflow.plans.pictures import picture_rows
from mediaflow.plans.registry import query, table
from mediaflow.storage import scratch_path

RATE = 0.5
LINEAR = {
    "input": [64],
    "layers": [{"kind": "dense", "units": CLASSES}, {"kind": "softmax"}],
    "loss": "categorical",
}

STEPS_SQL = """
with x as (select vec_id, label, unnest(range(64))::int as d, unnest(embedding)::double as v
           from embeddings
           union all select vec_id, label, 64 as d, 1.0::double as v from embeddings),
classes as (select unnest(range(10))::int as c),
n as (select count(*)::double as n from embeddings),
first as (select d, c, -0.5::double * sum(v * (0.1::double - (label = c)::int)) / any_value(n) as w
          from x, classes, n group by d, c),
logit as (select vec_id, label, c, sum(v * w) as z from x join first using (d)
          group by vec_id, label, c),
share as (select vec_id, label, c, exp(z) / sum(exp(z)) over (partition by vec_id) as p from logit),
step as (select d, c, -0.5::double * sum(v * (p - (share.label = c)::int)) / any_value(n) as s
         from x join share using (vec_id), n group by d, c)
"""

TWO_STEPS_SQL = f"""{STEPS_SQL}
select 0::int as layer, (d * 10 + c)::int as pos, round(w + s, 9) + 0.0::double as weight
from first join step using (d, c)
"""


HISTORY_SQL = f"""{STEPS_SQL}
select 1::int as epoch, count(*) as n, round(ln(10), 9) as loss,
round(avg((label = 0)::int), 9) as accuracy from embeddings
union all
select 2::int as epoch, count(*) as n, round(avg(-ln(p)), 9) as loss,
round(avg((label = top)::int), 9) as accuracy from (
select any_value(label) as label, arg_max(c, p) as top, max(p) filter (c = label) as p
from share group by vec_id)
"""

EXCHANGE_SQL = f"""{STEPS_SQL}
select 0::int as layer, (d * 10 + c)::int as pos,
case when abs(w) < 1e-15 then 0.0::double
else round(0.01::double * w / (abs(w) + 1e-7::double), 9) end as weight from first
"""


def _whole_batch_trainer(**settings) -> AveragedNetwork:
    """One step per epoch over all rows, which averaging over partitions gives exactly."""
    return AveragedNetwork(
        spec=LINEAR,
        featuresCol="embedding",
        optimizerSettings={"rate": RATE},
        batchSize=0,
        initial="zero",
        **settings,
    )


@query("averaged_train", TWO_STEPS_SQL)
def averaged_train(spark: SparkSession, folder: str) -> DataFrame:
    """Weights after two epochs."""
    trainer = _whole_batch_trainer(epochs=2)
    weights = trainer.fit(table(spark, folder, "embeddings")).weight_table(spark)
    return weights.withColumn("weight", F.round("weight", 9))


@query("training_history", HISTORY_SQL)
def training_history(spark: SparkSession, folder: str) -> DataFrame:
    """Loss and accuracy of the weights each of two epochs started from."""
    trainer = _whole_batch_trainer(epochs=2)
    history = trainer.fit(table(spark, folder, "embeddings")).history(spark)
    return history.select(
        "epoch", "n", F.round("loss", 9).alias("loss"), F.round("accuracy", 9).alias("accuracy")
    )


@query("exchange_train", EXCHANGE_SQL)
def exchange_train(spark: SparkSession, folder: str) -> DataFrame:
    """Weights after one epoch whose averaged difference is taken over by an adaptive rule."""
    trainer = _whole_batch_trainer(epochs=1, exchange="adagrad")
    weights = trainer.fit(table(spark, folder, "embeddings")).weight_table(spark)
    return weights.withColumn("weight", F.round("weight", 9))


@query("sorted_train", TWO_STEPS_SQL)
def sorted_train(spark: SparkSession, folder: str) -> DataFrame:
    """The same weights from rows that lie sorted by label in many partitions."""
    rows = table(spark, folder, "embeddings").repartitionByRange(32, "label").sortWithinPartitions("label")
    weights = _whole_batch_trainer(epochs=2).fit(rows).weight_table(spark)
    return weights.withColumn("weight", F.round("weight", 9))


@query(
    "validated_train",
    """with x as (select vec_id, label, vec_id % 4 = 0 as held, unnest(range(64))::int as d,
           unnest(embedding)::double as v from embeddings
           union all select vec_id, label, vec_id % 4 = 0, 64 as d, 1.0::double as v from embeddings),
    classes as (select unnest(range(10))::int as c),
    n as (select count(*)::double as n from embeddings where vec_id % 4 <> 0),
    first as (select d, c, -0.5::double * sum(v * (0.1::double - (label = c)::int)) / any_value(n) as w
          from x, classes, n where not held group by d, c),
    logit as (select vec_id, any_value(label) as label, c, sum(v * w) as z from x join first using (d)
          where held group by vec_id, c),
    share as (select vec_id, label, c, exp(z) / sum(exp(z)) over (partition by vec_id) as p from logit)
    select 1::int as epoch, (select n::bigint from n) as n, count(*) as val_n,
    round(avg(-ln(p)), 9) as val_loss, round(avg((label = top)::int), 9) as val_accuracy from (
    select any_value(label) as label, arg_max(c, p) as top, max(p) filter (c = label) as p
    from share group by vec_id)""",
)
def validated_train(spark: SparkSession, folder: str) -> DataFrame:
    """Loss and accuracy, after an epoch over the other rows, of rows set apart by a column."""
    rows = table(spark, folder, "embeddings").withColumn("apart", F.col("vec_id") % 4 == 0)
    history = _whole_batch_trainer(epochs=1, validationIndicatorCol="apart").fit(rows).history(spark)
    measured = [F.round(name, 9).alias(name) for name in ("val_loss", "val_accuracy")]
    return history.select("epoch", "n", "val_n", *measured)


# The first step of each rule from zero weights; g is the gradient, of which the plain step takes half.
FIRST_STEPS = {
    "adagrad": "0.01::double * g / (abs(g) + 1e-7::double)",
    "rmsprop": "0.001::double * g / (sqrt(0.1::double) * abs(g) + 1e-7::double)",
    "adam": """0.001::double * sqrt(0.001::double) / 0.1::double * 0.1::double * g
        / (sqrt(0.001::double) * abs(g) + 1e-7::double)""",
    "adadelta": "g * sqrt(1e-7::double) / sqrt(0.05::double * g * g + 1e-7::double)",
}


def _rule_query(rule: str) -> None:
    @query(
        f"rule_{rule}",
        f"""{STEPS_SQL} select 0::int as layer, (d * 10 + c)::int as pos,
        round(-({FIRST_STEPS[rule]}), 7) + 0.0::double as weight
        from (select d, c, w / -{RATE}::double as g from first)""",
    )
    def first_step(spark: SparkSession, folder: str) -> DataFrame:
        """Weights after one step of the rule over all rows."""
        trainer = AveragedNetwork(
            spec=LINEAR, featuresCol="embedding", optimizer=rule, batchSize=0, initial="zero", epochs=1, numWorkers=1
        )
        weights = trainer.fit(table(spark, folder, "embeddings")).weight_table(spark)
        return weights.withColumn("weight", F.round("weight", 7) + F.lit(0.0))


for _rule in FIRST_STEPS:
    _rule_query(_rule)


PREDICT_SQL = """with x as (select vec_id, unnest(range(64)) as d, unnest(embedding)::double as v
    from embeddings), z as (select vec_id, c, sum(v * (((d * 7 + c * 3) % 11 - 5) / 10.0::double)) as z
    from x, (select unnest(range(10)) as c) group by vec_id, c)
    select vec_id, arg_max(c, z)::int as prediction from z group by vec_id"""


def _linear_model() -> AveragedNetworkModel:
    d, c = np.meshgrid(np.arange(64), np.arange(CLASSES), indexing="ij")
    weights = np.concatenate([(((d * 7 + c * 3) % 11 - 5) / 10).ravel(), np.zeros(CLASSES)])
    return AveragedNetworkModel.of(LINEAR, weights, featuresCol="embedding")


def _predicted(model: AveragedNetworkModel, spark: SparkSession, folder: str) -> DataFrame:
    scored = model.transform(table(spark, folder, "embeddings"))
    return scored.select("vec_id", F.col("prediction").cast("int").alias("prediction"))


@query("predict_classes", PREDICT_SQL)
def predict_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Classes by a linear network with set weights."""
    return _predicted(_linear_model(), spark, folder)


@query("model_roundtrip", PREDICT_SQL)
def model_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """The same classes by the same network, saved and loaded."""
    path = scratch_path(spark, "model")
    _linear_model().save(path)
    return _predicted(AveragedNetworkModel.load(path), spark, folder)


SMALL_CONV = {
    "input": [SIDE, SIDE, 3],
    "layers": [
        {"kind": "conv", "filters": 2, "size": 3},
        {"kind": "relu"},
        {"kind": "pool", "size": 2},
        {"kind": "flatten"},
        {"kind": "dense", "units": 2},
        {"kind": "softmax"},
    ],
    "loss": "categorical",
}


@query(
    "cnn_scores",
    f"""with w as (select i, ((i * 7) % 11 - 5) / 10.0::double as w
    from (select unnest(range(94)) as i)),
    px as (select vec_id, p // 24 as y, (p % 24) // 3 as x, p % 3 as ch, v from (
    select vec_id, unnest(range(192)) as p, unnest(x) as v from ({PIXELS_SQL}))),
    kernel as (select unnest(range(3)) as dy, k.* from (select unnest(range(3)) as dx, q.* from (
    select unnest(range(3)) as ch, f from (select unnest(range(2)) as f)) q) k),
    conv as (select vec_id, y - dy as y, x - dx as x, f, sum(v * w) as s from px
    join kernel using (ch) join w on w.i = ((dy * 3 + dx) * 3 + ch) * 2 + f
    where y - dy between 0 and 5 and x - dx between 0 and 5 group by vec_id, y - dy, x - dx, f),
    pool as (select vec_id, y // 2 as y, x // 2 as x, f, max(greatest(s + w, 0)) as v
    from conv join w on w.i = 54 + f group by vec_id, y // 2, x // 2, f),
    out as (select vec_id, o, sum(v * w.w) + any_value(b.w) as z from pool,
    (select unnest(range(2)) as o) outs join w on w.i = 56 + ((y * 3 + x) * 2 + f) * 2 + o
    join w b on b.i = 92 + o group by vec_id, o)
    select vec_id, round(1 / (1 + exp(max(z) filter (o = 1) - max(z) filter (o = 0))), 9) as score_0,
    round(1 / (1 + exp(max(z) filter (o = 0) - max(z) filter (o = 1))), 9) as score_1
    from out group by vec_id""",
)
def cnn_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Outputs of a small convolutional network with set weights."""
    weights = ((np.arange(94) * 7) % 11 - 5) / 10
    model = AveragedNetworkModel.of(SMALL_CONV, weights, featuresCol="pixels", scoresCol="scores")
    scored = model.transform(pixel_rows(spark, folder))
    return scored.select(
        "vec_id",
        F.round(F.col("scores")[0], 9).alias("score_0"),
        F.round(F.col("scores")[1], 9).alias("score_1"),
    )


# The rows of the test split: their keys and labels. Which class training predicts is not for SQL to say.
HELD_OUT = "('0x' || substr(md5({key} || ':314'), 1, 8))::bigint / 4294967296.0::double >= 0.8::double"


def _is_class(count: int) -> Column:
    return F.col("prediction").isin([float(c) for c in range(count)]).alias("is_class")


@query(
    "mlp_predict",
    f"""select vec_id, label::double as label, true as is_class from embeddings
    where {HELD_OUT.format(key="vec_id::varchar")}""",
)
def mlp_predict(spark: SparkSession, folder: str) -> DataFrame:
    """Spark's own perceptron, trained on one split and applied to the other."""
    rows = table(spark, folder, "embeddings").select(
        "vec_id", F.col("label").cast("double").alias("label"), to_vector("embedding").alias("features")
    )
    train, test = hash_split(rows, "vec_id", [80, 20], 314)
    trainer = MultilayerPerceptronClassifier(layers=[64, 32, CLASSES], maxIter=20, seed=314)
    return trainer.fit(train).transform(test).select("vec_id", "label", _is_class(CLASSES))


@query(
    "estimator_fit",
    """select epoch::int as epoch, count(*) filter (u >= 0.15::double) as n,
    count(*) filter (u < 0.15::double) as val_n, true as is_finite
    from (select ('0x' || substr(md5(vec_id::varchar || ':0'), 1, 8))::bigint / 4294967296.0::double as u
    from embeddings), (select unnest([1, 2, 3]) as epoch) group by epoch""",
)
def estimator_fit(spark: SparkSession, folder: str) -> DataFrame:
    """History of a dense network with ReLU and dropout, trained with a held-out share."""
    rows = table(spark, folder, "embeddings")
    trainer = AveragedNetwork(
        spec=network.dense_spec(64, CLASSES, (64, 64), 0.5),
        featuresCol="embedding",
        optimizer="adam",
        exchange="average",
        epochs=3,
        batchSize=128,
        validationSplit=0.15,
        idCol="vec_id",
        seed=0,
    )
    finite = F.col("loss").between(0, 1e6) & F.col("val_loss").between(0, 1e6)
    return trainer.fit(rows).history(spark).select("epoch", "n", "val_n", finite.alias("is_finite"))


@query(
    "cnn_predict",
    f"""select vec_id, (label >= {CLASSES // 2})::int as label, true as is_class from embeddings
    where {HELD_OUT.format(key="vec_id::varchar")}""",
)
def cnn_predict(spark: SparkSession, folder: str) -> DataFrame:
    """The three-block convolutional network on pictures resized to 32 x 32, for two classes."""
    # Split before resizing, so that each picture is resized for its own part only.
    train, test = (
        images.resize_pixels(part, "pixels", (SIDE, SIDE), (32, 32)).select(
            "vec_id",
            (F.col("label") >= CLASSES // 2).cast("int").alias("label"),
            scale_by("pixels").cast("array<float>").alias("features"),
        )
        for part in hash_split(picture_rows(spark, folder), "vec_id", [80, 20], 314)
    )
    trainer = AveragedNetwork(
        spec=network.conv_spec(32, 32, 2),
        optimizer="rmsprop",
        epochs=2,
        batchSize=32,
        precision="single",
    )
    return trainer.fit(train).transform(test).select("vec_id", "label", _is_class(2))


# Mean and spread of the features of the training rows, one linear step from zero weights over them, and the class of
# the largest score for the rows held out.
STAGED_SQL = f"""with lines as (select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as id,
l_returnflag as category, [l_quantity, l_extendedprice, l_discount, l_tax] as x from lineitem),
parts as (select *, {HELD_OUT.format(key="id")} as held from lines),
ranks as (select category, (row_number() over (order by count(*) desc, category) - 1)::int as k
from parts where not held group by category),
cells as (select id, k, held, unnest(range(4)) as j, unnest(x) as v from parts join ranks using (category)),
spread as (select j, avg(v) as mean, stddev_samp(v) as sd from cells where not held group by j),
scaled as (select id, k, held, j, case when sd = 0 then 0 else (v - mean) / sd end as z from cells join spread using (j)
union all select id, k, held, 4, 1.0 from parts join ranks using (category)),
weights as (select c, j, avg((case when k = c then 1.0::double else 0.0 end - 1 / 3.0::double) * z) as w
from scaled, (select unnest(range(3)) as c) where not held group by c, j),
scores as (select id, k, c, sum(z * w) as s from scaled join weights using (j) where held group by id, k, c)
select id, k::double as index_category, arg_max(c, s)::double as prediction from scores group by id, k"""


@query("staged_predict", STAGED_SQL)
def staged_predict(spark: SparkSession, folder: str) -> DataFrame:
    """Label index, standardisation and classifier fitted as one unit on one split of the lines, applied to the other."""
    numbers = F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    rows = table(spark, folder, "lineitem").select(
        key.alias("id"), to_vector(numbers).alias("features"), F.col("l_returnflag").alias("category")
    )
    train, test = hash_split(rows, "id", [80, 20], 314)
    stages = Pipeline(
        stages=[
            features.string_indexer("category", "index_category"),
            features.standard_scaler("features", "scaled_features"),
            LinearClassifier(featuresCol="scaled_features", labelCol="index_category", numClasses=3),
        ]
    )
    return stages.fit(train).transform(test).select("id", "index_category", "prediction")


def _step_sql(before: str | None, part: int) -> str:
    """Weights (c, j, w) after a step over one of two parts of the cells (vec_id, label, part, j, v)."""
    scores = "select vec_id, c, 0.0::double as s from cells, classes where j = 0" if before is None else (
        f"select vec_id, c, sum(v * w) as s from cells join {before} using (j) group by vec_id, c"
    )
    old = "0.0::double" if before is None else f"(select w from {before} b where b.c = t.c and b.j = t.j)"
    return f"""select c, j, {old} - 2.0::double * slope as w from (
    select c, j, avg((p - case when label = c then 1.0::double else 0.0 end) * v) as slope from cells join (
    select vec_id, c, exp(s) / sum(exp(s)) over (partition by vec_id) as p from ({scores})) using (vec_id)
    where part = {part} group by c, j) t"""


@query(
    "linear_steps",
    f"""with classes as (select unnest(range({CLASSES})) as c),
    dealt as (select vec_id, label, embedding, floor(('0x' || substr(md5(vec_id::varchar || ':5'), 1, 8))::bigint
    / 4294967296.0::double * 2)::int as part from embeddings),
    cells as (select vec_id, label, part, unnest(range(64)) as j, unnest(embedding)::double as v from dealt
    union all select vec_id, label, part, 64, 1.0::double from dealt),
    first as ({_step_sql(None, 0)}),
    second as ({_step_sql("first", 1)}),
    scores as (select vec_id, label, c, sum(v * w) as s from cells join second using (j) group by vec_id, label, c)
    select vec_id, label, arg_max(c, s)::double as prediction, round(max(s), 9) as score from scores group by vec_id, label""",
)
def linear_steps(spark: SparkSession, folder: str) -> DataFrame:
    """Two steps over two mini-batches; each row's class and its score."""
    rows = table(spark, folder, "embeddings")
    trainer = LinearClassifier(
        featuresCol="embedding", numClasses=CLASSES, steps=2, batches=2, rate=2.0, idCol="vec_id", seed=5
    )
    model = trainer.fit(rows)
    scores = class_scores(with_one(rows, "embedding"), model.matrix())
    told = model.transform(rows).withColumn("score", F.round(F.array_max(scores), 9))
    return told.select("vec_id", "label", "prediction", "score")
