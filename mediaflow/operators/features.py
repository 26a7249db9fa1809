"""Feature statistics and scaling, on Spark ML."""

from __future__ import annotations

from pyspark.ml.common import _py2java
from pyspark.ml.feature import StandardScaler, StandardScalerModel, StringIndexer, StringIndexerModel
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaflow.functions.tensors import to_array, to_vector

# Spark hashes up to 128 groups per task and sorts beyond, so 2**19 positions stay hashed.
CHUNK = 4096


def chunked(df: DataFrame, values: str, chunk: int = CHUNK) -> DataFrame:
    """Cut long arrays into pieces of ``chunk`` values: (chunk_id, piece)."""
    starts = F.sequence(F.lit(1), F.size(values), F.lit(chunk))
    pieces = F.transform(starts, lambda start: F.slice(F.col(values), start, F.lit(chunk)))
    return df.filter(F.size(values) > 0).select(F.posexplode(pieces).alias("chunk_id", "piece"))


def feature_stats(df: DataFrame, values: str, chunk: int = CHUNK) -> DataFrame:
    """Count, mean, sample sd, minimum and maximum per array position.

    Rows are cut into pieces rather than single values, so wide arrays cost width / chunk narrow
    rows each, and every reducer merges the partial sums of its own positions only.
    """
    summary = Summarizer.metrics("count", "mean", "std", "min", "max").summary(F.col("vector"))
    per_chunk = (
        chunked(df, values, chunk)
        .select("chunk_id", to_vector("piece").alias("vector"))
        .groupBy("chunk_id")
        .agg(summary.alias("s"))
    )
    zipped = F.arrays_zip(
        to_array("s.mean").alias("mean"),
        to_array("s.std").alias("sd"),
        to_array("s.min").alias("low"),
        to_array("s.max").alias("high"),
    )
    return (
        per_chunk.select(
            "chunk_id", F.col("s.count").alias("n"), F.posexplode(zipped).alias("at", "v")
        )
        .select(
            (F.col("chunk_id") * chunk + F.col("at")).cast("int").alias("pos"),
            "n",
            F.col("v.mean").alias("mean"),
            F.col("v.sd").alias("sd"),
            F.col("v.low").alias("low"),
            F.col("v.high").alias("high"),
        )
    )


def partial_stats(df: DataFrame, values: str, chunk: int = CHUNK) -> DataFrame:
    """(start, n, mean, m2, low, high): statistics that can be stored and merged, one row for each piece of the arrays.

    ``start`` is the first position of the piece, ``m2`` the sum of squared distances from the mean.
    """
    summary = Summarizer.metrics("count", "mean", "variance", "min", "max").summary(F.col("vector"))
    per_chunk = (
        chunked(df, values, chunk)
        .select("chunk_id", to_vector("piece").alias("vector"))
        .groupBy("chunk_id")
        .agg(summary.alias("s"))
    )
    spread = F.col("s.count") - 1
    return per_chunk.select(
        (F.col("chunk_id") * chunk).cast("int").alias("start"),
        F.col("s.count").alias("n"),
        to_array("s.mean").alias("mean"),
        F.transform(to_array("s.variance"), lambda v: v * spread).alias("m2"),
        to_array("s.min").alias("low"),
        to_array("s.max").alias("high"),
    )


def merged_stats(parts: DataFrame) -> DataFrame:
    """Statistics per position, as ``feature_stats`` gives them, from stored parts of any number of tables.

    The rows behind the parts are not read again. Parts may cut the arrays into pieces of different lengths. Distances
    are taken from the merged mean, so parts far from zero or from one another lose no digits.
    """
    zipped = F.arrays_zip("mean", "m2", "low", "high")
    at = parts.select("start", "n", F.posexplode(zipped).alias("at", "v")).select(
        (F.col("start") + F.col("at")).alias("pos"), "n", "v.*"
    )
    # One exchange by position serves the means and the sums; a position has one row for each part.
    position = Window.partitionBy("pos")
    total = F.sum("n").over(position)
    centred = at.withColumn("whole", F.sum(F.col("n") * F.col("mean")).over(position) / total)
    merged = centred.groupBy("pos").agg(
        F.sum("n").alias("n"),
        F.first("whole").alias("mean"),
        F.sum(F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("whole"), F.lit(2.0))).alias("m2"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    )
    sd = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))).otherwise(F.lit(0.0))
    return merged.select("pos", "n", "mean", sd.alias("sd"), "low", "high")


def length_range(df: DataFrame, values: str) -> DataFrame:
    size = F.size(values)
    return df.select(size.alias("length")).agg(
        F.min("length").alias("min_length"), F.max("length").alias("max_length")
    )


def describe_lengths(df: DataFrame, length: Column) -> DataFrame:
    return df.select(length.alias("length")).agg(
        F.count("length").alias("n"),
        F.avg("length").alias("mean"),
        F.stddev_samp("length").alias("sd"),
        F.min("length").alias("low"),
        F.max("length").alias("high"),
    )


def input_dim(df: DataFrame, values: str) -> int:
    """Common array length of a table; raises if rows disagree."""
    row = length_range(df.filter(F.col(values).isNotNull()), values).first()
    if row["min_length"] is None:
        raise ValueError(f"column {values} has no arrays")
    if row["min_length"] != row["max_length"]:
        raise ValueError(
            f"column {values} has arrays of {row['min_length']} to {row['max_length']} values"
        )
    return row["min_length"]


def class_count(df: DataFrame, label: str) -> DataFrame:
    return df.agg(F.countDistinct(label).alias("n_classes"))


def label_frequency(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def string_indexer(
    input_col: str, output_col: str, order: str = "frequencyDesc"
) -> StringIndexer:
    """Index by falling frequency, ties in alphabetical order."""
    return StringIndexer(inputCol=input_col, outputCol=output_col, stringOrderType=order)


def string_index(
    df: DataFrame, input_col: str, output_col: str, order: str = "frequencyDesc"
) -> tuple[DataFrame, StringIndexerModel]:
    model = string_indexer(input_col, output_col, order).fit(df)
    return model.transform(df), model


def standard_scaler(
    input_col: str, output_col: str, with_mean: bool = True, with_std: bool = True
) -> StandardScaler:
    return StandardScaler(
        inputCol=input_col, outputCol=output_col, withMean=with_mean, withStd=with_std
    )


def standardize(
    df: DataFrame,
    values: str,
    output_col: str,
    with_mean: bool = True,
    with_std: bool = True,
) -> tuple[DataFrame, StandardScalerModel]:
    """Scale an array column by its own statistics; the result is an array column.

    The statistics are merged by pieces of the arrays, not in one task; one mean and one standard
    deviation per position come to the driver, and make Spark's own scaler model.
    """
    stats = feature_stats(df, values).select("pos", "n", "mean", "sd").orderBy("pos").toArrow()
    counts = set(stats["n"].to_pylist())
    if len(counts) != 1:
        raise ValueError(f"column {values} has no arrays, or arrays of different lengths")
    context = df.sparkSession.sparkContext
    sd, mean = (_py2java(context, Vectors.dense(stats[name].to_numpy())) for name in ("sd", "mean"))
    kind = context._jvm.org.apache.spark.ml.feature.StandardScalerModel
    model = StandardScalerModel(kind(standard_scaler("in", "out").uid, sd, mean))
    model._set(inputCol="__vector", outputCol="__scaled", withMean=with_mean, withStd=with_std)
    vectors = df.withColumn("__vector", to_vector(values))
    scaled = model.transform(vectors).withColumn(output_col, to_array("__scaled"))
    return scaled.drop("__vector", "__scaled"), model
