"""Vectors as arrays of doubles, in column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def finite(v: Column) -> Column:
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def unit(v: Column) -> Column:
    """The vector at length 1. A vector that is not finite, or too short to have a direction, is an error."""
    n = norm(v)
    scaled = F.transform(v, lambda x: x.cast("double") / n)
    return F.when(finite(v) & (n >= 1e-12), scaled).otherwise(F.raise_error(F.lit("vector is not finite or has no direction")).cast("array<double>"))
