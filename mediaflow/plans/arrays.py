"""Queries over arrays: pixels, labels as arrays, feature statistics and scaling, evaluation.

Arrays leave as rows (id, pos, value). The embeddings stand in for pictures: every value v of an
embedding becomes a pixel (v, -v, v * v), so 64 values give an 8 x 8 picture of three channels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaflow.functions import tensors
from mediaflow.operators import evaluate, features
from mediaflow.plans.registry import query, table

SIDE = 8
CLASSES = 10

PIXELS_SQL = """select vec_id, label, flatten([[v::double, -v::double, v::double * v::double]
for v in embedding]) as x from embeddings"""


def pixel_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(vec_id, label, pixels): one 8 x 8 x 3 array per embedding."""
    rows = table(spark, folder, "embeddings")
    dots = F.transform(
        F.transform("embedding", lambda v: v.cast("double")), lambda v: F.array(v, -v, v * v)
    )
    return rows.select("vec_id", "label", F.flatten(dots).alias("pixels"))


def exploded(df: DataFrame, array: Column, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode(array).alias("pos", "value"))


def exploded_sql(array: str, source: str, n: str, keys: str = "vec_id") -> str:
    return f"""select {keys}, unnest(range({n}))::int as pos, unnest({array})::double as value
    from ({source})"""


@query("rename_features", exploded_sql("embedding", "select * from embeddings", "len(embedding)",
                                       "vec_id, label, label as category"))
def rename_features(spark: SparkSession, folder: str) -> DataFrame:
    renamed = (
        table(spark, folder, "embeddings")
        .withColumnRenamed("embedding", "imgnpa")
        .withColumn("features", F.col("imgnpa"))
        .withColumn("category", F.col("label"))
    )
    out = exploded(renamed, F.col("features"), "vec_id", "label", "category")
    return out.withColumn("value", F.col("value").cast("double"))


@query(
    "features_labels",
    """select vec_id, len(embedding)::int as n_features, round(list_sum(embedding::double[]), 6)
    as feature_sum, unnest(range(10))::int as class,
    unnest([case when c = label then 1.0::double else 0.0::double end for c in range(10)]) as is_class
    from embeddings""",
)
def features_labels(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    pairs = rows.select(
        "vec_id",
        F.col("embedding").alias("features"),
        tensors.one_hot("label", CLASSES).alias("target"),
    )
    total = F.aggregate("features", F.lit(0.0), lambda acc, x: acc + x)
    return pairs.select(
        "vec_id",
        F.size("features").alias("n_features"),
        F.round(total, 6).alias("feature_sum"),
        F.posexplode("target").alias("class", "is_class"),
    )


@query(
    "filter_shape",
    "select doc_id, len(string_split(text, chr(10)))::int as n_lines from documents "
    "where len(string_split(text, chr(10))) = 4",
)
def filter_shape(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "documents").select(
        "doc_id", F.split("text", "\n").alias("lines")
    )
    kept = lines.filter(tensors.has_shape("lines", 2, 2, 1))
    return kept.select("doc_id", F.size("lines").alias("n_lines"))


@query(
    "input_dim",
    "select min(len(embedding))::int as n_inputs from embeddings "
    "having min(len(embedding)) = max(len(embedding))",
)
def input_dim(spark: SparkSession, folder: str) -> DataFrame:
    found = features.length_range(table(spark, folder, "embeddings"), "embedding")
    return found.filter("min_length = max_length").select(F.col("min_length").alias("n_inputs"))


@query(
    "length_range",
    """select min(len(string_split(text, ' ')))::int as min_length,
    max(len(string_split(text, ' ')))::int as max_length from documents""",
)
def length_range(spark: SparkSession, folder: str) -> DataFrame:
    words = table(spark, folder, "documents").select(F.split("text", " ").alias("words"))
    return features.length_range(words, "words")


@query("vector_roundtrip", exploded_sql("embedding", "select * from embeddings", "len(embedding)"))
def vector_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    vectors = rows.select("vec_id", tensors.to_vector("embedding").alias("vector"))
    return exploded(vectors, tensors.to_array("vector"), "vec_id")


@query(
    "channel_planes",
    f"""select vec_id, c::int as plane, (i // 8)::int as line, (i % 8)::int as at,
    x[i * 3 + c + 1] as value
    from ({PIXELS_SQL}), (select unnest(range(64)) as i), (select unnest(range(3)) as c)""",
)
def channel_planes(spark: SparkSession, folder: str) -> DataFrame:
    rows = pixel_rows(spark, folder)
    planes = rows.select("vec_id", tensors.channel_planes("pixels", SIDE).alias("planes"))
    lines = planes.select("vec_id", F.posexplode("planes").alias("plane", "lines")).select(
        "vec_id", "plane", F.posexplode("lines").alias("line", "values")
    )
    return lines.select("vec_id", "plane", "line", F.posexplode("values").alias("at", "value"))


@query(
    "channel_planes_w2",
    f"""select vec_id, 1::int as n_leading, 3::int as n_planes, 32::int as n_lines,
    unnest(range(192))::int as pos, unnest([x[(i % 64) * 3 + (i // 64) + 1] for i in range(192)])
    as value from ({PIXELS_SQL})""",
)
def channel_planes_w2(spark: SparkSession, folder: str) -> DataFrame:
    rows = pixel_rows(spark, folder)
    nested = tensors.channel_planes("pixels", 2, leading_axis=True)
    tensor = rows.select("vec_id", nested.alias("tensor"))
    return tensor.select(
        "vec_id",
        F.size("tensor").alias("n_leading"),
        F.size(F.col("tensor")[0]).alias("n_planes"),
        F.size(F.col("tensor")[0][0]).alias("n_lines"),
        F.posexplode(tensors.flatten_rows("tensor", 3)).alias("pos", "value"),
    )


@query(
    "reshape_rows",
    """select vec_id, (i // 16)::int as line, (i % 16)::int as at, embedding[i + 1]::double as value
    from embeddings, (select unnest(range(64)) as i)""",
)
def reshape_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    lines = rows.select(
        "vec_id", F.posexplode(tensors.reshape_rows("embedding", 16)).alias("line", "values")
    )
    out = lines.select("vec_id", "line", F.posexplode("values").alias("at", "value"))
    return out.withColumn("value", F.col("value").cast("double"))


@query("array_flatten", exploded_sql("x", PIXELS_SQL, "192"))
def array_flatten(spark: SparkSession, folder: str) -> DataFrame:
    rows = pixel_rows(spark, folder)
    nested = rows.select("vec_id", tensors.reshape_rows("pixels", 3).alias("dots"))
    return exploded(nested, tensors.flatten_rows("dots"), "vec_id")


@query(
    "layout_convert",
    exploded_sql("[x[(i % 64) * 3 + (i // 64) + 1] for i in range(192)]", PIXELS_SQL, "192"),
)
def layout_convert(spark: SparkSession, folder: str) -> DataFrame:
    rows = pixel_rows(spark, folder)
    return exploded(rows, tensors.interleaved_to_planar("pixels", SIDE, SIDE), "vec_id")


@query("layout_roundtrip", exploded_sql("x", PIXELS_SQL, "192"))
def layout_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    planar = pixel_rows(spark, folder).select(
        "vec_id", tensors.interleaved_to_planar("pixels", SIDE, SIDE).alias("planar")
    )
    return exploded(planar, tensors.planar_to_interleaved("planar", SIDE, SIDE), "vec_id")


@query(
    "flip_horizontal",
    exploded_sql(
        "[x[(i // 24) * 24 + (7 - (i % 24) // 3) * 3 + i % 3 + 1] for i in range(192)]",
        PIXELS_SQL,
        "192",
    ),
)
def flip_horizontal(spark: SparkSession, folder: str) -> DataFrame:
    return exploded(
        pixel_rows(spark, folder), tensors.flip_horizontal("pixels", SIDE), "vec_id"
    )


@query("scale_255", exploded_sql("[v / 255.0::double for v in x]", PIXELS_SQL, "192"))
def scale_255(spark: SparkSession, folder: str) -> DataFrame:
    return exploded(pixel_rows(spark, folder), tensors.scale_by("pixels"), "vec_id")


@query(
    "side_length",
    "select vec_id, floor(sqrt(len(embedding) * 3 / 3.0))::int as side from embeddings",
)
def side_length(spark: SparkSession, folder: str) -> DataFrame:
    rows = pixel_rows(spark, folder)
    return rows.select("vec_id", tensors.side_length("pixels").alias("side"))


ONE_HOT_SQL = "[case when c = label then 1.0::double else 0.0::double end for c in range(10)]"


@query("one_hot", exploded_sql(ONE_HOT_SQL, "select * from embeddings", "10"))
def one_hot(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", "label")
    return exploded(rows, tensors.one_hot("label", CLASSES), "vec_id")


@query(
    "argmax_label",
    """select vec_id, label as label_back, (list_position(embedding, list_max(embedding)) - 1)::int
    as top from embeddings""",
)
def argmax_label(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").withColumn(
        "encoded", tensors.one_hot("label", CLASSES)
    )
    return rows.select(
        "vec_id",
        tensors.arg_max("encoded").alias("label_back"),
        tensors.arg_max("embedding").alias("top"),
    )


SOFTMAX_SQL = """select vec_id, label, [exp(v::double) / list_sum([exp(w::double) for w in embedding])
for v in embedding] as p from embeddings"""


@query(
    "softmax_scores",
    """select vec_id, pos, round(value, 9) as value from ("""
    + exploded_sql("p", SOFTMAX_SQL, "64")
    + ")",
)
def softmax_scores(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    scores = exploded(rows, tensors.softmax("embedding"), "vec_id")
    return scores.withColumn("value", F.round("value", 9))


@query(
    "activations",
    """select event_id, greatest(value - 50, 0.0::double) as relu,
    round(1 / (1 + exp(-(value - 50) / 10)), 9) as sigmoid from events""",
)
def activations(spark: SparkSession, folder: str) -> DataFrame:
    shifted = F.col("value") - 50
    return table(spark, folder, "events").select(
        "event_id",
        tensors.relu(shifted).alias("relu"),
        F.round(tensors.sigmoid(shifted / 10), 9).alias("sigmoid"),
    )


STATS_SQL = """select pos, avg(v) as mean, stddev_samp(v) as sd, min(v) as low, max(v) as high,
count(*) as n from (select unnest(range(len(embedding)))::int as pos, unnest(embedding)::double as v
from embeddings) group by pos"""


@query(
    "feature_stats",
    f"""select pos, n, round(mean, 9) as mean, round(sd, 9) as sd, low, high from ({STATS_SQL})""",
)
def feature_stats(spark: SparkSession, folder: str) -> DataFrame:
    stats = features.feature_stats(table(spark, folder, "embeddings"), "embedding")
    return stats.withColumn("mean", F.round("mean", 9)).withColumn("sd", F.round("sd", 9))


def _scaled_sql(shift: str) -> str:
    return f"""select vec_id, pos, round((v - {shift}) / sd, 6) + 0.0 as value from (
    select vec_id, unnest(range(len(embedding)))::int as pos, unnest(embedding)::double as v
    from embeddings) join ({STATS_SQL}) using (pos)"""


def _scaled(spark: SparkSession, folder: str, with_mean: bool) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    scaled, _ = features.standardize(rows, "embedding", "scaled", with_mean=with_mean)
    return exploded(scaled, F.col("scaled"), "vec_id").withColumn("value", F.round("value", 6))


@query("standardize", _scaled_sql("mean"))
def standardize(spark: SparkSession, folder: str) -> DataFrame:
    return _scaled(spark, folder, True)


@query("scale_sd_only", _scaled_sql("0"))
def scale_sd_only(spark: SparkSession, folder: str) -> DataFrame:
    return _scaled(spark, folder, False)


PREDICTED_SQL = """select vec_id, label,
((list_position(embedding, list_max(embedding)) - 1) % 10)::int as prediction from embeddings"""


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """A fixed guess per embedding: the position of its largest value, folded onto ten classes."""
    rows = table(spark, folder, "embeddings")
    guess = F.pmod(tensors.arg_max("embedding"), F.lit(CLASSES)).cast("int")
    return rows.select("vec_id", "label", guess.alias("prediction"))


@query(
    "confusion_long",
    f"select label, prediction, count(*) as n from ({PREDICTED_SQL}) group by label, prediction",
)
def confusion_long(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.confusion_long(predictions(spark, folder))


@query(
    "confusion_wide",
    "select c::int as label, "
    + ", ".join(
        f"count(*) filter (prediction = {c}) as predicted_{c}" for c in range(CLASSES + 1)
    )
    + f""", count(*) filter (p.vec_id is not null and coalesce(prediction not between 0 and {CLASSES}, true))
    as predicted_other
    from (select unnest(range({CLASSES + 1})) as c union all select null) left join ({PREDICTED_SQL}) p
    on p.label is not distinct from c group by c""",
)
def confusion_wide(spark: SparkSession, folder: str) -> DataFrame:
    # One class more than there are, to show the zero row and column.
    return evaluate.confusion_wide(predictions(spark, folder), range(CLASSES + 1))


@query(
    "accuracy",
    f"""select round(avg(case when label = prediction then 1.0::double else 0.0::double end), 9)
    as accuracy from ({PREDICTED_SQL})""",
)
def accuracy(spark: SparkSession, folder: str) -> DataFrame:
    found = evaluate.accuracy(predictions(spark, folder))
    return found.select(F.round("accuracy", 9).alias("accuracy"))


@query(
    "overall_precision",
    f"""select round(count(*) filter (label = prediction)::double / count(prediction), 9)
    as precision from ({PREDICTED_SQL})""",
)
def overall_precision(spark: SparkSession, folder: str) -> DataFrame:
    found = evaluate.overall_precision(predictions(spark, folder))
    return found.select(F.round("precision", 9).alias("precision"))


@query(
    "precision_recall",
    f"""select class, n_hit, n_predicted, n_true,
    round(case when n_predicted > 0 then n_hit::double / n_predicted end, 9) as precision,
    round(case when n_true > 0 then n_hit::double / n_true end, 9) as recall from (
    select c::int as class, (count(*) filter (label = c and prediction = c))::bigint as n_hit,
    (count(*) filter (prediction = c))::bigint as n_predicted,
    (count(*) filter (label = c))::bigint as n_true
    from ({PREDICTED_SQL}), (select unnest(range({CLASSES})) as c) group by c)""",
)
def precision_recall(spark: SparkSession, folder: str) -> DataFrame:
    found = evaluate.precision_recall(predictions(spark, folder), range(CLASSES))
    return found.withColumn("precision", F.round("precision", 9)).withColumn(
        "recall", F.round("recall", 9)
    )


@query(
    "log_loss",
    f"select round(avg(-ln(greatest(p[label + 1], 1e-15::double))), 9) as log_loss from ({SOFTMAX_SQL})",
)
def log_loss(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select(
        "label", tensors.softmax("embedding").alias("scores")
    )
    found = evaluate.categorical_log_loss(rows, "scores")
    return found.select(F.round("log_loss", 9).alias("log_loss"))


@query(
    "binary_log_loss",
    """select round(avg(-ln(greatest(case when is_late = 1 then p else 1 - p end, 1e-15::double))), 9)
    as log_loss from (select case when l_linestatus = 'O' then 1 else 0 end as is_late,
    1 / (1 + exp(-(l_quantity - 25) / 10)) as p from lineitem)""",
)
def binary_log_loss(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select(
        F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("label"),
        tensors.sigmoid((F.col("l_quantity") - 25) / 10).alias("score"),
    )
    found = evaluate.binary_log_loss(rows, "score")
    return found.select(F.round("log_loss", 9).alias("log_loss"))


# Every seventh prediction and score missing, every fifth label none of the classes.
GAPS_SQL = f"""select vec_id, case when vec_id % 5 = 0 then {CLASSES} + 3 else label end as label,
case when vec_id % 7 <> 0 then prediction end as prediction from ({PREDICTED_SQL})"""


def predictions_with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return predictions(spark, folder).select(
        "vec_id",
        F.when(F.col("vec_id") % 5 == 0, CLASSES + 3).otherwise(F.col("label")).alias("label"),
        F.when(F.col("vec_id") % 7 != 0, F.col("prediction")).alias("prediction"),
    )


@query(
    "confusion_gaps",
    "select c::int as label, "
    + ", ".join(f"count(*) filter (prediction = {c}) as predicted_{c}" for c in range(CLASSES))
    + f""", count(*) filter (p.vec_id is not null and prediction is null) as predicted_other
    from (select unnest(range({CLASSES})) as c union all select null) left join ({GAPS_SQL}) p
    on case when p.label < {CLASSES} then p.label end is not distinct from c group by c""",
)
def confusion_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.confusion_wide(predictions_with_gaps(spark, folder), range(CLASSES))


@query(
    "precision_gaps",
    f"""select class, n_hit, n_predicted, n_true,
    round(case when n_predicted > 0 then n_hit::double / n_predicted end, 9) as precision,
    round(case when n_true > 0 then n_hit::double / n_true end, 9) as recall,
    (select round(count(*) filter (label = prediction)::double / count(prediction), 9) from ({GAPS_SQL})) as overall
    from (select c::int as class, (count(*) filter (label = c and prediction = c))::bigint as n_hit,
    (count(*) filter (prediction = c))::bigint as n_predicted,
    (count(*) filter (label = c))::bigint as n_true
    from ({GAPS_SQL}), (select unnest(range({CLASSES})) as c) group by c)""",
)
def precision_gaps(spark: SparkSession, folder: str) -> DataFrame:
    rows = predictions_with_gaps(spark, folder)
    overall = evaluate.overall_precision(rows).select(F.round("precision", 9).alias("overall"))
    found = evaluate.precision_recall(rows, range(CLASSES))
    rounded = {name: F.round(name, 9) for name in ("precision", "recall")}
    return found.withColumns(rounded).crossJoin(F.broadcast(overall))  # one row


@query(
    "log_loss_gaps",
    """select round(avg(case when p is not null then -ln(greatest(case when is_late = 1 then p else 1 - p end,
    1e-15::double)) end), 9) as log_loss from (
    select case when l_linestatus = 'O' then 1 else 0 end as is_late,
    case when l_linenumber <> 3 then 1 / (1 + exp(-(l_quantity - 25) / 10)) end as p from lineitem)""",
)
def log_loss_gaps(spark: SparkSession, folder: str) -> DataFrame:
    score = F.when(F.col("l_linenumber") != 3, tensors.sigmoid((F.col("l_quantity") - 25) / 10))
    rows = table(spark, folder, "lineitem").select(
        F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("label"), score.alias("score")
    )
    found = evaluate.binary_log_loss(rows, "score")
    return found.select(F.round("log_loss", 9).alias("log_loss"))


@query(
    "relu_gaps",
    """select l_orderkey, l_linenumber, l_partkey,
    case when l_linenumber <> 3 then greatest(l_quantity - 25, 0.0::double) end as value from lineitem""",
)
def relu_gaps(spark: SparkSession, folder: str) -> DataFrame:
    value = F.when(F.col("l_linenumber") != 3, F.col("l_quantity") - 25)
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", tensors.relu(value).alias("value")
    )
