"""Table sources and sinks."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaflow.functions.tensors import (
    first_part,
    last_part,
    to_floats,
    to_vector,
    without_ends,
    without_first,
)
from mediaflow.operators.sampling import random_order
from mediaflow.schemas import require_columns, require_schema
from mediaflow.storage import delete_path, move_path, path_exists

# The first field of header lines, and the label of rows that have none.
HEADER_TOKEN = "id"
UNKNOWN_LABEL = "Class_1"


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | None = None
) -> DataFrame:
    """Parquet table; with a schema, its columns are checked against it."""
    df = spark.read.parquet(path)
    return df if schema is None else require_schema(df, schema)


def split_lines(lines: DataFrame, header_token: str = HEADER_TOKEN) -> DataFrame:
    """Lines (column ``value``) cut at every comma, quotes or not, into the array ``parts``.

    Lines whose first field is the header token are dropped wherever they stand.
    """
    require_columns(lines, ["value"])
    parts = lines.select(F.split("value", ",").alias("parts"))
    return parts.filter(first_part("parts") != header_token)


def labelled_features(
    parts: DataFrame, train: bool = True, strict: bool = True, vectors: bool = False
) -> DataFrame:
    """(features, category) from cut lines: id, features..., and in training also a label.

    Rows to score have no label and get a fixed one. ``vectors`` gives dense vectors.
    """
    if train:
        features, category = without_ends("parts"), last_part("parts")
    else:
        features, category = without_first("parts"), F.lit(UNKNOWN_LABEL)
    numbers = to_floats(features, strict)
    return parts.select(
        (to_vector(numbers) if vectors else numbers).alias("features"),
        category.alias("category"),
    )


def load_lines(
    spark: SparkSession,
    path: str,
    train: bool = True,
    shuffle_seed: int | None = None,
    strict: bool = True,
    vectors: bool = False,
) -> DataFrame:
    """Text files of comma-cut lines as (features, category). The files are never changed."""
    parts = split_lines(spark.read.text(path))
    loaded = labelled_features(parts, train, strict, vectors)
    return loaded if shuffle_seed is None else random_order(loaded, shuffle_seed)


def load_csv(
    spark: SparkSession,
    path: str,
    n_features: int,
    train: bool = True,
    header: bool = False,
    strict: bool = True,
) -> DataFrame:
    """Quoted CSV files as (id, features, category), with a declared schema.

    ``header`` skips the first line of each file; header lines further down are dropped too.
    ``strict`` fails on bad numbers and on rows of another width.
    """
    names = [f"f{i}" for i in range(n_features)]
    texts = ["id", *names] + (["category"] if train else [])
    schema = T.StructType([T.StructField(name, T.StringType()) for name in texts])
    mode = "FAILFAST" if strict else "PERMISSIVE"
    rows = spark.read.csv(path, schema=schema, header=header, mode=mode)
    rows = rows.filter(F.col("id").isNull() | (F.col("id") != HEADER_TOKEN))
    features = to_floats(F.array(*names), strict)
    category = F.col("category") if train else F.lit(UNKNOWN_LABEL)
    return rows.select("id", features.alias("features"), category.alias("category"))


# --- lines that are checked, not dropped ------------------------------------------------------------

PARSED, CORRUPT = "__parsed", "__corrupt"
# What can be wrong with a line.
WRONG_WIDTH, NOT_A_NUMBER = "width", "number"


def checked_lines(
    lines: DataFrame,
    n_features: int,
    train: bool = True,
    quoted: bool = False,
    header_token: str = HEADER_TOKEN,
) -> DataFrame:
    """(id, features, category, problem, bad_line) for every line (column ``value``) that is no header, in one pass.

    A good line has no problem. One of another width has the problem ``width``, one with a feature that is no number, an
    empty or missing one included, ``number``; it keeps its whole text in ``bad_line`` and has no features or category.
    ``quoted`` reads fields as quoted CSV, else lines are cut at every comma. Empty lines have the wrong width.
    """
    require_columns(lines, ["value"])
    names = ["id", *[f"f{i}" for i in range(n_features)], *(["category"] if train else [])]
    whole = F.coalesce(F.col("value"), F.lit(""))
    if quoted:
        ddl = ", ".join(f"{name} string" for name in [*names, CORRUPT])
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
        parsed = lines.select("value", F.from_csv(whole, ddl, options).alias(PARSED))
        field = F.col(PARSED)
        right_width = field[CORRUPT].isNull() & (F.trim(whole) != "")
        parts = F.array(*[field[name] for name in names])
    else:
        parsed = lines.select("value", F.split(whole, ",").alias(PARSED))
        parts = F.col(PARSED)
        right_width = F.size(parts) == len(names)
    numbers = F.transform(F.slice(parts, 2, n_features), lambda x: x.try_cast("float"))
    rows = parsed.select(
        "value",
        F.get(parts, F.lit(0)).alias("id"),
        F.when(right_width, numbers).alias("features"),
        F.when(right_width, F.get(parts, F.lit(len(names) - 1)) if train else F.lit(UNKNOWN_LABEL)).alias("category"),
    ).filter(F.col("id").isNull() | (F.col("id") != header_token))
    problem = F.when(F.col("features").isNull(), WRONG_WIDTH).when(
        F.exists("features", lambda x: x.isNull()), NOT_A_NUMBER
    )
    good = F.col("problem").isNull()
    return rows.withColumn("problem", problem).select(
        F.when(good, F.col("id")).alias("id"),
        F.when(good, F.col("features")).alias("features"),
        F.when(good, F.col("category")).alias("category"),
        "problem",
        F.when(~good, F.coalesce("value", F.lit(""))).alias("bad_line"),
    )


def write_checked(checked: DataFrame, path: str) -> None:
    """Store good and bad lines in one pass, each in a partition of its own."""
    write_table(checked.withColumn("is_bad", F.col("problem").isNotNull()), path, partition_by=["is_bad"])


def read_checked(spark: SparkSession, path: str, bad: bool = False) -> DataFrame:
    """The good lines of a stored load as (id, features, category), or the bad ones as (problem, bad_line)."""
    schema = "id string, features array<float>, category string, problem string, bad_line string, is_bad boolean"
    rows = spark.read.schema(schema).parquet(path).filter(F.col("is_bad") == bad)
    return rows.select("problem", "bad_line") if bad else rows.select("id", "features", "category")


# --- sinks -----------------------------------------------------------------------------------------


def write_table(
    df: DataFrame,
    path: str,
    overwrite: bool = False,
    partition_by: Sequence[str] = (),
) -> None:
    """Parquet sink. Fails if the path exists, unless told to overwrite; then see ``replace_table``."""
    if overwrite:
        replace_table(df, path, partition_by)
        return
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def replace_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write a table in place of the one at ``path``, which may be among the sources of ``df``.

    The new table is written beside the old one and takes its place when all of it is there. A job that fails leaves the
    old table as it was; a driver that dies between the two renames leaves both under names that start with the path.
    """
    spark = df.sparkSession
    path = path.rstrip("/")
    run = uuid.uuid4().hex
    fresh, old = f"{path}.new-{run}", f"{path}.old-{run}"
    try:
        write_table(df, fresh, partition_by=partition_by)
    except BaseException:
        delete_path(spark, fresh)
        raise
    had = path_exists(spark, path)
    if had:
        move_path(spark, path, old)
    try:
        move_path(spark, fresh, path)
    except BaseException:
        if had:
            move_path(spark, old, path)
        raise
    if had:
        delete_path(spark, old)


def replace_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Write the partitions that ``df`` has rows of in place of the same ones at ``path``; all others stay.

    Partitions are moved in when every task has succeeded, so a failed job leaves the old ones. An empty table
    changes nothing. ``df`` must not read the partitions it replaces.
    """
    require_columns(df, partition_by)
    if not partition_by:
        raise ValueError("no partition columns")
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partition_by).parquet(path)


# --- counts that a sink takes as it writes -----------------------------------------------------------


def write_counted(
    df: DataFrame,
    path: str,
    label_col: str,
    labels: Sequence[object],
    required: Sequence[str] = (),
    overwrite: bool = False,
    partition_by: Sequence[str] = (),
) -> dict[str, object]:
    """Write a table and count its rows on the way, in the one job that writes them.

    Rows with a NULL in a ``required`` column are left out. Gives ``rows_in``, ``dropped`` (those left out),
    ``rows_out`` and ``per_label``: the rows written of each label named, and under None those of all others.
    """
    require_columns(df, [label_col, *required])
    seen, written = Observation(), Observation()
    label = F.col(f"`{label_col}`")
    complete: Column = F.lit(True)
    for name in required:
        complete = complete & F.col(f"`{name}`").isNotNull()
    # The counter stands below the filter, so that no filter is pushed past it.
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows_in")).filter(complete)
    counters = [F.count_if(label == value).alias(f"n{i}") for i, value in enumerate(labels)]
    counted = counted.observe(written, F.count(F.lit(1)).alias("rows_out"), *counters)
    write_table(counted, path, overwrite, partition_by)
    rows_in, out = seen.get["rows_in"], written.get
    per_label: dict[object, int] = {value: out[f"n{i}"] for i, value in enumerate(labels)}
    per_label[None] = out["rows_out"] - sum(per_label.values())
    return {"rows_in": rows_in, "dropped": rows_in - out["rows_out"], "rows_out": out["rows_out"], "per_label": per_label}


# --- bucketed tables ---------------------------------------------------------------------------------


def write_bucketed(
    df: DataFrame,
    name: str,
    keys: Sequence[str],
    buckets: int,
    path: str | None = None,
    overwrite: bool = False,
    spread: int = 1,
) -> None:
    """Table of the session's catalog, dealt into buckets by its keys and sorted by them within each file.

    Tables with equal buckets are joined or grouped by their keys without an exchange. ``spread`` tasks share the writing
    of a bucket, for buckets with a hot key; but one task reads a bucket, so a key that holds more than a task can
    read is better left to ``lookup_join``, which splits it.
    """
    require_columns(df, keys)
    key_columns = [F.col(f"`{key}`") for key in keys]
    if spread > 1:
        bucket = F.pmod(F.hash(*key_columns), F.lit(buckets))
        turn = df.withColumn("__turn", F.monotonically_increasing_id() % spread)
        dealt = turn.repartition(buckets * spread, bucket, F.col("__turn")).drop("__turn")
    else:
        dealt = df.repartition(buckets, *key_columns)
    writer = dealt.write.format("parquet").mode("overwrite" if overwrite else "errorifexists")
    writer = writer.bucketBy(buckets, *keys).sortBy(*keys)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


def register_bucketed(
    spark: SparkSession, name: str, path: str, schema: T.StructType, keys: Sequence[str], buckets: int
) -> DataFrame:
    """Name bucketed files that another session has written; needed where the catalog lives and dies with the session."""
    columns = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in schema.fields)
    listed = ", ".join(f"`{key}`" for key in keys)
    location = path.replace("'", "\\'")
    spark.sql(
        f"create table {name} ({columns}) using parquet clustered by ({listed}) sorted by ({listed}) "
        f"into {int(buckets)} buckets location '{location}'"
    )
    return spark.table(name)
