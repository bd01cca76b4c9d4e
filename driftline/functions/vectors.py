"""Vectors as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def distance(a: str | Column, b: str | Column) -> Column:
    """The Euclidean distance."""
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def norm(a: str) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def normalised(a: str, length: str) -> Column:
    """``a`` over its length; a zero vector has null values."""
    return F.transform(a, lambda x: F.try_divide(x.cast("double"), F.col(length)))
