"""Vectors as array columns. Arithmetic is in double, whatever the arrays hold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Dot product: the cosine, for vectors of unit length. Null if one is null."""
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def length(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    n = length(v)
    return F.when(n > 0, F.transform(as_double(v), lambda x: x / n)).otherwise(as_double(v))


def mix(a: Column, b: Column, share: float) -> Column:
    """Unit vector of (1 - share) * a + share * b; `a` alone where `b` is null."""
    return unit(F.when(b.isNull(), as_double(a)).otherwise(F.zip_with(as_double(a), as_double(b), lambda x, y: x * (1 - share) + y * share)))
