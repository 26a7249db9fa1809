"""Random order, limits and splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaflow.functions.hashing import drawn_below, seeded_digest
from mediaflow.schemas import require_columns


def random_order(df: DataFrame, seed: int) -> DataFrame:
    """Global random order. Each row draws its own number, so copies spread over all ranges."""
    return df.orderBy(F.rand(seed))


def shuffle_rows(df: DataFrame, key: str, seed: int, order_col: str = "order_key") -> DataFrame:
    """Repeatable global random order: by a digest of the key, which stays as a column.

    Rows of one key have one digest. The row number drawn last breaks such ties, so that the range
    partitioner can cut through a key that holds a large share of the rows.
    """
    require_columns(df, [key])
    keyed = df.withColumn(order_col, seeded_digest(F.col(key), seed))
    return keyed.orderBy(order_col, key, F.rand(seed))


def limit_then_filter(
    df: DataFrame, n: int, predicate: Column, order_by: str | None = None
) -> DataFrame:
    """Take n rows, then filter: at most n rows. Which rows is settled only with ``order_by``."""
    taken = df.limit(n) if order_by is None else df.orderBy(order_by).limit(n)
    return taken.filter(predicate)


def filter_then_limit(
    df: DataFrame, n: int, predicate: Column, order_by: str | None = None
) -> DataFrame:
    """Filter, then take n of the rows that pass."""
    passed = df.filter(predicate)
    return passed.limit(n) if order_by is None else passed.orderBy(order_by).limit(n)


def head_rows(df: DataFrame, n: int, *order_by: str) -> DataFrame:
    """The first n rows in the given order (a top-k, not a full sort)."""
    return df.orderBy(*order_by).limit(n)


def split_column(
    key: str | Column, weights: Mapping[str, float], seed: int | str
) -> Column:
    """Name of the part a key belongs to; parts take shares in proportion to their weights."""
    column = F.col(key) if isinstance(key, str) else key
    digest = seeded_digest(column, seed)
    total = float(sum(weights.values()))
    names = list(weights)
    reached = 0.0
    chosen: Column | None = None
    for name in names[:-1]:
        reached += weights[name]
        hit = drawn_below(digest, reached / total)
        chosen = F.when(hit, name) if chosen is None else chosen.when(hit, name)
    return F.lit(names[-1]) if chosen is None else chosen.otherwise(names[-1])


def with_split(
    df: DataFrame,
    key: str | Column,
    weights: Mapping[str, float],
    seed: int | str,
    split_col: str = "split",
) -> DataFrame:
    """Append the part name. A row's part depends on key and seed only, never on the layout."""
    return df.withColumn(split_col, split_column(key, weights, seed))


def hash_split(
    df: DataFrame, key: str | Column, weights: Sequence[float], seed: int | str
) -> list[DataFrame]:
    """Disjoint parts that cover the table; a narrow filter each, with no sort and no shuffle."""
    named = {str(i): weight for i, weight in enumerate(weights)}
    chosen = split_column(key, named, seed)
    return [df.filter(chosen == name) for name in named]


def random_split(df: DataFrame, weights: Sequence[float], seed: int) -> list[DataFrame]:
    """Row-wise random split. Repeatable for one layout of the input only; see ``hash_split``."""
    return df.randomSplit(list(weights), seed)
