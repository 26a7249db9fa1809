"""Column expressions over pixel arrays and feature arrays; all run inside the JVM.

A picture of height h, width w and c channels is one flat array. *Interleaved* means row by row
with the channels of a pixel together (h, w, c); *planar* means one plane per channel (c, h, w).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def bound_once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row; NULL for a NULL value.

    Inside a lambda an expression runs again for every element; the variable of an outer lambda
    does not.
    """
    return F.transform(F.array(value), lambda v: F.when(v.isNotNull(), body(v)))[0]


def _range(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


def first_part(values: str | Column) -> Column:
    return F.element_at(_column(values), 1)


def last_part(values: str | Column) -> Column:
    return F.element_at(_column(values), -1)


def without_first(values: str | Column) -> Column:
    values = _column(values)
    return F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0)))


def without_ends(values: str | Column) -> Column:
    values = _column(values)
    return F.slice(values, F.lit(2), F.greatest(F.size(values) - 2, F.lit(0)))


def to_floats(values: str | Column, strict: bool = True) -> Column:
    """Cast text to 32-bit floats. ``strict`` raises on bad text, otherwise it becomes NULL."""
    if strict:
        return F.transform(_column(values), lambda x: x.cast("float"))
    return F.transform(_column(values), lambda x: x.try_cast("float"))


def to_vector(values: str | Column) -> Column:
    return array_to_vector(_column(values))


def to_array(vector: str | Column, dtype: str = "float64") -> Column:
    return vector_to_array(_column(vector), dtype)


def has_shape(values: str | Column, height: int, width: int, channels: int = 3) -> Column:
    """Whether the array has the contract length; false for NULL."""
    return F.coalesce(F.size(_column(values)) == height * width * channels, F.lit(False))


def side_length(values: str | Column, channels: int = 3) -> Column:
    """Side of a square picture from its array length; NULL if the length is no such square."""
    count = F.size(_column(values))
    side = F.floor(F.sqrt(count / F.lit(channels)) + F.lit(1e-9)).cast("int")
    return F.when(side * side * channels == count, side)


def flatten_rows(nested: str | Column, depth: int = 1) -> Column:
    flat = _column(nested)
    for _ in range(depth):
        flat = F.flatten(flat)
    return flat


def channel(values: str | Column, index: int, channels: int = 3) -> Column:
    """Every ``channels``-th value starting at ``index``."""

    def picked(flat: Column) -> Column:
        places = F.sequence(F.lit(index), F.greatest(F.size(flat) - 1, F.lit(index)), F.lit(channels))
        return F.when(
            F.size(flat) > index, F.transform(places, lambda at: flat[at])
        ).otherwise(F.slice(flat, F.lit(1), F.lit(0)))

    return bound_once(_column(values), picked)


def reshape_rows(values: str | Column, width: int) -> Column:
    """Rows of ``width`` values. The length must be a multiple of it, else the query fails."""

    def cut(flat: Column) -> Column:
        count = F.size(flat)
        starts = F.sequence(F.lit(1), F.greatest(count, F.lit(1)), F.lit(width))
        rows = F.filter(
            F.transform(starts, lambda start: F.slice(flat, start, F.lit(width))),
            lambda row: F.size(row) > 0,
        )
        problem = F.format_string(f"%d values are no multiple of {width}", count)
        return F.when(count % width != 0, F.raise_error(problem)).otherwise(rows)

    return bound_once(_column(values), cut)


def channel_planes(
    values: str | Column, width: int, channels: int = 3, leading_axis: bool = False
) -> Column:
    """Interleaved array to channel planes, each as rows of ``width`` values."""
    flat = F.array(*[channel(values, c, channels) for c in range(channels)])
    planes = F.transform(flat, lambda plane: reshape_rows(plane, width))
    nested = F.array(planes) if leading_axis else planes
    return F.when(_column(values).isNotNull(), nested)


def _of_length(flat: Column, n: int, result: Column) -> Column:
    problem = F.format_string(f"%d values where {n} belong", F.size(flat))
    return F.when(F.size(flat) != n, F.raise_error(problem)).otherwise(result)


def interleaved_to_planar(
    values: str | Column, height: int, width: int, channels: int = 3
) -> Column:
    n = height * width * channels

    def moved(flat: Column) -> Column:
        # The places are the same for every row: the optimizer folds them into one literal.
        places = F.flatten(
            F.array(*[F.sequence(F.lit(c), F.lit(n - 1), F.lit(channels)) for c in range(channels)])
        )
        return _of_length(flat, n, F.transform(places, lambda at: flat[at]))

    return bound_once(_column(values), moved)


def planar_to_interleaved(
    values: str | Column, height: int, width: int, channels: int = 3
) -> Column:
    area = height * width

    def moved(flat: Column) -> Column:
        dots = F.transform(
            _range(area), lambda at: F.array(*[flat[at + c * area] for c in range(channels)])
        )
        return _of_length(flat, area * channels, F.flatten(dots))

    return bound_once(_column(values), moved)


def flip_horizontal(values: str | Column, width: int, channels: int = 3) -> Column:
    """Mirror an interleaved picture left to right."""
    stride = width * channels
    mirrored = F.flatten(
        F.transform(
            F.sequence(F.lit(width - 1), F.lit(0), F.lit(-1)),
            lambda x: F.sequence(x * channels, x * channels + (channels - 1)),
        )
    )

    def flip(flat: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(flat) - 1, F.lit(0)), F.lit(stride))

        def rows(line: Column) -> Column:
            return F.transform(starts, lambda start: F.transform(line, lambda at: flat[start + at]))

        flipped = F.flatten(bound_once(mirrored, rows))
        return F.when(F.size(flat) == 0, flat).otherwise(flipped)

    return bound_once(_column(values), flip)


def scale_by(values: str | Column, divisor: float = 255.0) -> Column:
    return F.transform(_column(values), lambda x: x / F.lit(divisor))


def one_hot(label: str | Column, classes: int) -> Column:
    """0/1 array of ``classes`` values; NULL for a NULL label. A label outside fails the query."""
    label = _column(label)
    encoded = F.transform(
        _range(classes), lambda i: F.when(i == label.cast("int"), 1.0).otherwise(0.0)
    )
    problem = F.concat(F.lit("label outside the classes: "), label.cast("string"))
    inside = (label >= 0) & (label < classes)
    return F.when(label.isNull(), None).when(inside, encoded).otherwise(F.raise_error(problem))


def arg_max(scores: str | Column) -> Column:
    """Position of the first largest value."""
    scores = _column(scores)
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def relu(value: str | Column) -> Column:
    value = _column(value)
    return F.when(value.isNotNull(), F.greatest(value, F.lit(0.0)))


def sigmoid(value: str | Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_column(value)))


def softmax(scores: str | Column) -> Column:
    """Softmax over an array, shifted by its maximum so that large scores do not overflow."""
    scores = _column(scores)

    def shares(powers: Column) -> Column:
        total = F.aggregate(powers, F.lit(0.0), lambda acc, x: acc + x)
        return bound_once(total, lambda sum_: F.transform(powers, lambda p: p / sum_))

    def powers_below(top: Column) -> Column:
        return F.transform(scores, lambda x: F.exp(x.cast("double") - top.cast("double")))

    return bound_once(bound_once(F.array_max(scores), powers_below), shares)
