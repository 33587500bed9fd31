"""Numeric helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def p95(values: Column) -> Column:
    """Nearest-rank 95th percentile of an array, with the rank rounded half to even; 0.0 for an empty one."""
    rank = F.greatest(F.lit(1), F.rint(0.95 * F.size(values)).cast("int"))
    return F.when(F.size(values) == 0, F.lit(0.0)).otherwise(F.element_at(F.array_sort(values), rank))


def upper_median(values: Column) -> Column:
    """The middle element, the upper one of two."""
    return F.element_at(F.array_sort(values), F.floor(F.size(values) / 2).cast("int") + 1)


def rounded(value: Column, digits: int) -> Column:
    """value as SQL rounds doubles: the product with a power of ten, to the nearest integer, halves away from zero, divided again.

    Spark's round takes the decimal digits that the double is printed with, so it carries 2.675 to 2.68.
    """
    return F.round(value * 10.0**digits) / 10.0**digits


def edge_bin(value: Column, low: float, high: float, bins: int) -> Column:
    """Number of the equal-width bin, with everything outside in the edge bins."""
    return F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((value - low) / (high - low) * bins).cast("int")))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, null for an empty whole."""
    return part / F.when(whole != 0, whole)


def quantized(vector: Column) -> Column:
    """int8 codes of a vector by its largest magnitude, rounded half to even; zeros for a zero vector."""
    top = F.array_max(F.transform(vector, lambda x: F.abs(x)))
    return F.transform(vector, lambda x: F.when(top == 0, F.lit(0)).otherwise(F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.rint(x / top * 127.0)))).cast("int"))


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """v as doubles of length 1; null for a zero vector."""
    length = F.sqrt(dot(v, v))
    return F.when(length > 0, F.transform(v, lambda x: x.cast("double") / length))
