"""Tagging of records by label lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaflow.operators.joins import BROADCAST_LIMIT_BYTES, lookup_join
from mediaflow.schemas import require_columns

CLEAN = 0
CONTAMINATED = 1


class LabelConflict(ValueError):
    """A key carries more than one label."""


def filter_in_list(df: DataFrame, column: str, values: Sequence[object]) -> DataFrame:
    """Keep rows whose column equals a listed literal; goes down to the Parquet scan."""
    return df.filter(F.col(column).isin(list(values)))


def filter_by_list(
    df: DataFrame,
    keys: DataFrame,
    column: str,
    limit_bytes: int = BROADCAST_LIMIT_BYTES,
    filter_bytes: int = BROADCAST_LIMIT_BYTES,
) -> DataFrame:
    """Keep rows whose column is on a list held as a table; repeats on the list change nothing.

    A list over ``limit_bytes`` is joined by a shuffle, of which a Bloom filter of up to ``filter_bytes`` spares most
    rows that are not listed; 0 goes without.
    """
    listed = keys.select(column).filter(F.col(column).isNotNull()).distinct()
    return lookup_join(df, listed, column, "left_semi", limit_bytes, filter_bytes)


def with_label(df: DataFrame, label: int, label_col: str = "contaminated") -> DataFrame:
    return df.withColumn(label_col, F.lit(label).cast("int"))


def label_table(
    lists: Sequence[tuple[DataFrame, int]], key: str, label_col: str = "contaminated"
) -> DataFrame:
    """One (key, label) table from several key lists. Repeats go; a key on two lists stays twice."""
    parts = [with_label(keys.select(key), label, label_col) for keys, label in lists]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged.filter(F.col(key).isNotNull()).distinct()


def label_conflicts(labels: DataFrame, key: str, label_col: str = "contaminated") -> DataFrame:
    """Keys with more than one distinct label."""
    return (
        labels.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.min(label_col).alias("low"), F.max(label_col).alias("high"))
        .filter(F.col("low") != F.col("high"))
        .select(key)
    )


def tag(
    df: DataFrame,
    labels: DataFrame,
    key: str,
    label_col: str = "contaminated",
    on_conflict: str = "keep",
    limit_bytes: int = BROADCAST_LIMIT_BYTES,
    filter_bytes: int = BROADCAST_LIMIT_BYTES,
) -> DataFrame:
    """Keep the rows of ``df`` whose key is labelled and append the label, in one scan of ``df``.

    A NULL key matches nothing and repeated label rows do not multiply records. For a key with two
    labels ``on_conflict`` says what to do: ``keep`` gives the record once per label, ``drop``
    leaves it out, ``error`` raises. Labels over ``limit_bytes`` are joined by a shuffle; most records are unlabelled as
    a rule, and a Bloom filter of the label keys (``filter_bytes`` at most, 0 for none) drops them in the scan.
    """
    require_columns(df, [key])
    require_columns(labels, [key, label_col])
    pairs = labels.select(key, F.col(label_col).cast("int").alias(label_col)).filter(
        F.col(key).isNotNull()
    )
    if on_conflict == "keep":
        lookup = pairs.distinct()
    elif on_conflict in ("drop", "error"):
        lookup = (
            pairs.groupBy(key)
            .agg(F.min(label_col).alias(label_col), F.max(label_col).alias("__high"))
        )
        if on_conflict == "error":
            clash = lookup.filter(F.col(label_col) != F.col("__high")).select(key).take(5)
            if clash:
                raise LabelConflict(f"keys with two labels, such as {[r[0] for r in clash]}")
        lookup = lookup.filter(F.col(label_col) == F.col("__high")).drop("__high")
    else:
        raise ValueError(f"on_conflict must be keep, drop or error, not {on_conflict!r}")
    joined = lookup_join(df, lookup, key, "inner", limit_bytes, filter_bytes)
    return joined.select(*[F.col(f"`{name}`") for name in df.columns], label_col)


def tag_counts(tagged: DataFrame, key: str, label_col: str = "contaminated") -> DataFrame:
    """Rows and distinct keys per label.

    Rows are combined per (label, key) first, so a key with many rows is one row after the map side.
    """
    return (
        tagged.groupBy(label_col, key)
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(label_col)
        .agg(F.sum("n").alias("n_rows"), F.count(key).alias("n_keys"))
    )
