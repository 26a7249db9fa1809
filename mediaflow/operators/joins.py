"""Equi-joins against a table with few rows per key, for any size of it and any skew of the other side.

The lookup side is measured first. Under the size limit it is broadcast and the large side is not
shuffled at all. Over it, both sides are shuffled on the key. Spark splits the partitions of hot keys at run
time; where that is switched off, keys that hold a large share of the left rows are spread over several reducers:
the left rows by a salt that depends on the row, the few lookup rows of those keys by one copy per salt. Where few
left rows have a partner, a Bloom filter of the lookup keys can drop most others before they are shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaflow.operators.bloom import prefilter as bloom_prefilter

BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024
# Rows that are drawn per reducer to look for hot keys. The draw steers the plan, never the result.
DRAWN_PER_REDUCER = 1000
DRAW_SEED = 29
ROW_OVERHEAD_BYTES = 64
# Files so many times below the limit are not measured: they are not packed more than this.
MOST_COMPRESSION = 100
# Fixed value: the size Spark assumes for a table it knows nothing about.
NO_ESTIMATE_BYTES = 2**63 - 1

SALT = "__salt"
COPIES = "__copies"


def _column_bytes(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    kind = field.dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size: Column = F.octet_length(column)
    elif isinstance(kind, T.ArrayType) and not isinstance(
        kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)
    ):
        size = F.size(column) * 8
    elif isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        size = F.octet_length(F.to_json(F.struct(column)))
    else:
        size = F.lit(16)
    return F.coalesce(size.cast("bigint"), F.lit(0))


def fits_broadcast(df: DataFrame, limit_bytes: int = BROADCAST_LIMIT_BYTES) -> bool:
    """Whether the whole table stays under the limit.

    Spark's estimate from the file sizes turns away tables too large to be worth reading for this.
    Where it has none, as for rows handed over by the driver, counting as many rows as could fit
    does. An estimate can be too low for compressed files, so what is not far below the limit is measured
    by one aggregate.
    """
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if limit_bytes < estimate < NO_ESTIMATE_BYTES:
        return False
    if estimate >= NO_ESTIMATE_BYTES:
        most = limit_bytes // ROW_OVERHEAD_BYTES
        if df.limit(most + 1).count() > most:
            return False
    elif estimate * MOST_COMPRESSION <= limit_bytes:
        return True
    row_bytes = F.lit(ROW_OVERHEAD_BYTES).cast("bigint")
    for field in df.schema.fields:
        row_bytes = row_bytes + _column_bytes(field)
    total = df.agg(F.coalesce(F.sum(row_bytes), F.lit(0)).alias("total")).first()["total"]
    return total <= limit_bytes


def hot_keys(df: DataFrame, key: str, reducers: int) -> list[Row]:
    """Keys holding more than half of a reducer's fair share of the rows, and the copies each should get.

    Counted by a group-by over a sample whose size follows the number of reducers; at most two keys per
    reducer can pass.
    """
    keys = df.select(key).filter(F.col(key).isNotNull())
    total = keys.count()
    rate = min(1.0, DRAWN_PER_REDUCER * reducers / max(total, 1))
    drawn = keys.sample(rate, DRAW_SEED) if rate < 1 else keys
    floor = max(total * rate / (2 * reducers), 1)
    counts = drawn.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > floor).collect()
    return [Row(**{key: row[key], COPIES: min(math.ceil(row["n"] / floor), reducers)}) for row in counts]


def _splits_skew(spark) -> bool:
    """Whether Spark itself splits the partitions of hot keys at run time."""
    return all(
        spark.conf.get(name, "true") == "true"
        for name in ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled")
    )


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "inner",
    limit_bytes: int = BROADCAST_LIMIT_BYTES,
    filter_bytes: int = 0,
) -> DataFrame:
    """Join ``left`` to ``right`` on ``key``; ``how`` is inner, left, or left_semi.

    ``right`` must hold few rows per key. The result is that of ``left.join(right, key, how)``. With
    ``filter_bytes``, a join over the limit that keeps rows with a partner only drops most others by a Bloom filter of
    at most that size first; that costs one more pass over ``right`` and pays where most left rows have none.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(f"unsupported join {how!r}")
    if fits_broadcast(right, limit_bytes):
        return left.join(F.broadcast(right), key, how)
    if filter_bytes and how != "left":
        left = bloom_prefilter(left, right.select(key), key, filter_bytes)
    spark = left.sparkSession
    reducers = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = [] if _splits_skew(spark) else hot_keys(left, key, reducers)
    if not rows:
        return left.join(right, key, how)
    schema = T.StructType(
        [T.StructField(key, left.schema[key].dataType), T.StructField(COPIES, T.IntegerType())]
    )
    hot = F.broadcast(spark.createDataFrame(rows, schema))
    # Row content alone would keep identical copies together, so the input partition is mixed in;
    # both are the same when a lost task runs again.
    spread = F.xxhash64(F.spark_partition_id(), *_hashable(left))
    salted_left = left.join(hot, key, "left").withColumn(
        SALT, F.pmod(spread, F.coalesce(F.col(COPIES), F.lit(1))).cast("int")
    )
    salted_right = right.join(hot, key, "left").withColumn(
        SALT, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(COPIES), F.lit(1)) - 1))
    )
    joined = salted_left.drop(COPIES).join(salted_right.drop(COPIES), [key, SALT], how)
    return joined.drop(SALT)


def _hashable(df: DataFrame) -> list[Column]:
    return [
        F.col(f"`{field.name}`")
        for field in df.schema.fields
        if isinstance(field.dataType, T.AtomicType)
    ]
