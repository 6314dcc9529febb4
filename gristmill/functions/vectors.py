"""Vectors as array columns; all arithmetic is in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products; null if either is null or the sizes differ."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """Scaled to length one; null for a zero vector."""
    n = norm(v)
    return F.when(n > 0, F.transform(doubles(v), lambda x: x / n))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of the angle; null where a vector is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def or_zero(v: Column, dim: int) -> Column:
    """The vector, or `dim` zeros for null."""
    return F.coalesce(doubles(v), F.array_repeat(F.lit(0.0), dim))


def clean_number(c: Column) -> Column:
    """The number, 0 for null and NaN."""
    return F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))
