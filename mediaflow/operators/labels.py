"""Numbers for labels, found and kept as a table.

Labels are counted, range-partitioned in the order of their numbers and sorted; a label's number is its place in its
partition plus the rows of the partitions before. Only one row count for each partition is ever brought together, so
an index may have as many labels as the table has rows. It is applied by a join, broadcast where it is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mediaflow.operators.joins import BROADCAST_LIMIT_BYTES, lookup_join
from mediaflow.schemas import require_columns
from mediaflow.storage import scratch_path

ORDERS = ("frequencyDesc", "frequencyAsc", "alphabetDesc", "alphabetAsc")
UNSEEN = ("error", "skip", "keep", "null")

KEY, NUMBER = "__label", "__number"


def _order(name: str) -> list[Column]:
    """Sort keys; equal counts go by label."""
    if name not in ORDERS:
        raise ValueError(f"order must be one of {', '.join(ORDERS)}, not {name!r}")
    label, n = F.col("label"), F.col("n")
    return {
        "frequencyDesc": [n.desc(), label.asc()],
        "frequencyAsc": [n.asc(), label.asc()],
        "alphabetDesc": [label.desc()],
        "alphabetAsc": [label.asc()],
    }[name]


class LabelIndex:
    """Labels (text) and their numbers from 0, as a table (label, number)."""

    def __init__(self, table: DataFrame):
        require_columns(table, ["label", "number"])
        self.table = table.select("label", "number")

    def apply(
        self,
        df: DataFrame,
        input_col: str,
        output_col: str,
        unseen: str = "error",
        limit_bytes: int = BROADCAST_LIMIT_BYTES,
    ) -> DataFrame:
        """Append the number of each row's label, as a double.

        Labels that are not in the index, NULL among them, fail the job (``error``), leave their rows out (``skip``),
        get the next number after the last (``keep``) or NULL (``null``).
        """
        require_columns(df, [input_col])
        if unseen not in UNSEEN:
            raise ValueError(f"unseen must be one of {', '.join(UNSEEN)}, not {unseen!r}")
        if output_col in df.columns:
            raise ValueError(f"column {output_col} exists")
        label = F.col(f"`{input_col}`").cast("string")
        numbers = self.table.select(F.col("label").alias(KEY), F.col("number").cast("double").alias(NUMBER))
        how = "inner" if unseen == "skip" else "left"
        joined = lookup_join(df.withColumn(KEY, label), numbers, KEY, how, limit_bytes)
        number = F.col(NUMBER)
        if unseen == "keep":
            number = F.coalesce(number, F.lit(float(self.table.count())))
        elif unseen == "error":
            message = F.concat(F.lit("label without a number: "), F.coalesce(F.col(KEY), F.lit("NULL")))
            number = F.when(number.isNull(), F.raise_error(message)).otherwise(number)
        return joined.select(*[F.col(f"`{name}`") for name in df.columns], number.alias(output_col))

    def labels_of(
        self, df: DataFrame, number_col: str, output_col: str, limit_bytes: int = BROADCAST_LIMIT_BYTES
    ) -> DataFrame:
        """Append the label of each number; NULL for a number that is none."""
        require_columns(df, [number_col])
        names = self.table.select(F.col("number").cast("double").alias(NUMBER), F.col("label").alias(output_col))
        numbered = df.withColumn(NUMBER, F.col(f"`{number_col}`").cast("double"))
        return lookup_join(numbered, names, NUMBER, "left", limit_bytes).drop(NUMBER)

    def write(self, path: str) -> None:
        self.table.write.parquet(path)

    @staticmethod
    def read(spark: SparkSession, path: str) -> LabelIndex:
        return LabelIndex(spark.read.parquet(path))


def label_index(df: DataFrame, column: str, order: str = "frequencyDesc") -> LabelIndex:
    """Number the distinct labels of a column, most frequent first by default. NULL is no label."""
    require_columns(df, [column])
    keys = _order(order)
    spark = df.sparkSession
    counts = (
        df.select(F.col(f"`{column}`").cast("string").alias("label"))
        .filter("label is not null")
        .groupBy("label")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # The low 33 bits of these ids count the rows of a partition.
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    path = scratch_path(spark, "labels")
    counts.repartitionByRange(*keys).sortWithinPartitions(*keys).select(
        "label", F.spark_partition_id().alias("part"), place.alias("place")
    ).write.parquet(path)
    placed = spark.read.schema("label string, part int, place bigint").parquet(path)
    # One row for each partition, so the window holds no more rows than the shuffle had partitions.
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return LabelIndex(
        placed.join(F.broadcast(offsets), "part").select("label", (F.col("offset") + F.col("place")).alias("number"))
    )
