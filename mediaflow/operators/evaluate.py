"""Evaluation of prediction tables. Everything is one pre-aggregated groupBy away from the rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaflow.functions.tensors import arg_max

LOSS_FLOOR = 1e-15


def confusion_long(df: DataFrame, truth: str = "label", predicted: str = "prediction") -> DataFrame:
    return df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))


def _known(column: str, classes: Sequence[int]) -> Column:
    """The class a value stands for, NULL for none. Models predict doubles; as whole numbers they match the names."""
    value = F.col(column).cast("int")
    return F.when(value.isin(list(classes)), value)


def _per_class(cells: DataFrame, classes: Sequence[int | None], name: str) -> DataFrame:
    """A row for each class with all the cells in it, which classes bound in number; no join, and no class is missing."""
    together = cells.agg(F.collect_list(F.struct(*cells.columns)).alias("__cells"))
    rows = F.array(*[F.lit(c).cast("int") for c in classes])
    return together.select(F.explode(rows).alias(name), "__cells")


def _cells_where(condition: Callable[[Column], Column]) -> Column:
    """Rows in those cells that meet a condition."""
    chosen = F.filter("__cells", condition)
    return F.aggregate(chosen, F.lit(0).cast("bigint"), lambda total, cell: total + cell["n"])


def confusion_wide(
    df: DataFrame,
    classes: Sequence[int],
    truth: str = "label",
    predicted: str = "prediction",
) -> DataFrame:
    """Confusion matrix: one row per class of the truth, one column per predicted class.

    Classes that never occur are shown with zeros, on both sides. Whatever is NULL or none of the
    classes counts in a row whose truth is NULL and in ``predicted_other``, so the cells sum to the rows.
    """
    known = [int(c) for c in classes]
    pairs = df.select(_known(truth, known).alias("t"), _known(predicted, known).alias("p"))
    cells = pairs.groupBy("t", "p").agg(F.count(F.lit(1)).alias("n"))

    def cell(column: int | None) -> Column:
        of_row = F.col(truth)
        return _cells_where(lambda c: c["t"].eqNullSafe(of_row) & c["p"].eqNullSafe(F.lit(column)))

    names = {f"predicted_{c}": c for c in known} | {"predicted_other": None}
    rows = _per_class(cells, [*known, None], truth)
    return rows.select(truth, *[cell(column).alias(name) for name, column in names.items()])


def accuracy(df: DataFrame, truth: str = "label", predicted: str = "prediction") -> DataFrame:
    hit = F.when(F.col(truth) == F.col(predicted), 1.0).otherwise(0.0)
    return df.agg(F.avg(hit).alias("accuracy"))


def precision_recall(
    df: DataFrame,
    classes: Sequence[int],
    truth: str = "label",
    predicted: str = "prediction",
) -> DataFrame:
    """Per class: hits, predicted rows, true rows, precision and recall (NULL where undefined).

    The rows are counted once by (truth, prediction); a truth or prediction that is none of the classes counts against
    the class on its other side.
    """
    known = [int(c) for c in classes]
    hit = F.coalesce(F.col(truth) == F.col(predicted), F.lit(False))
    pairs = df.select(_known(truth, known).alias("t"), _known(predicted, known).alias("p"), hit.alias("hit"))
    cells = pairs.groupBy("t", "p", "hit").agg(F.count(F.lit(1)).alias("n"))
    return (
        _per_class(cells, known, "class")
        .select(
            "class",
            _cells_where(lambda c: c["hit"] & (c["t"] == F.col("class"))).alias("n_hit"),
            _cells_where(lambda c: c["p"] == F.col("class")).alias("n_predicted"),
            _cells_where(lambda c: c["t"] == F.col("class")).alias("n_true"),
        )
        .withColumn("precision", F.try_divide("n_hit", "n_predicted"))
        .withColumn("recall", F.try_divide("n_hit", "n_true"))
    )


def overall_precision(
    df: DataFrame, truth: str = "label", predicted: str = "prediction"
) -> DataFrame:
    """Micro-averaged precision over all classes: hits per row that has a prediction."""
    hits = F.count_if(F.col(truth) == F.col(predicted))
    return df.agg(F.try_divide(hits.cast("double"), F.count(predicted)).alias("precision"))


def cross_entropy(probability_of_truth: str | Column) -> Column:
    column = (
        F.col(probability_of_truth)
        if isinstance(probability_of_truth, str)
        else probability_of_truth
    )
    return F.when(column.isNotNull(), -F.log(F.greatest(column, F.lit(LOSS_FLOOR))))


def categorical_log_loss(df: DataFrame, scores: str, label: str = "label") -> DataFrame:
    """Mean cross-entropy of class scores that sum to 1, for integer labels, over rows that have both."""
    of_truth = F.get(F.col(scores), F.col(label).cast("int"))
    return df.agg(F.avg(cross_entropy(of_truth)).alias("log_loss"))


def binary_log_loss(df: DataFrame, score: str, label: str = "label") -> DataFrame:
    """Mean cross-entropy of the score for class 1, for labels 0 and 1, over rows that have both."""
    of_truth = F.when(F.col(label) == 1, F.col(score)).when(F.col(label) == 0, 1.0 - F.col(score))
    return df.agg(F.avg(cross_entropy(of_truth)).alias("log_loss"))


def with_predicted_class(
    df: DataFrame, scores: str, predicted: str = "prediction"
) -> DataFrame:
    return df.withColumn(predicted, arg_max(scores))


def count_if(df: DataFrame, predicate: Column) -> DataFrame:
    return df.agg(F.count_if(predicate).alias("n_passed"))


def unit_circle_estimate(df: DataFrame, x: Column, y: Column) -> DataFrame:
    """Four times the share of points inside the unit circle: an estimate of pi."""
    inside = x * x + y * y < 1
    return df.select(inside.alias("inside")).agg(
        F.count(F.lit(1)).alias("n_points"),
        F.count_if("inside").alias("n_inside"),
        (F.lit(4.0) * F.count_if("inside") / F.count(F.lit(1))).alias("pi"),
    )
