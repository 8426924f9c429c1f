"""Vector expressions over ARRAY<FLOAT> columns; all arithmetic in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector over its length; null for a zero vector and for one that is not finite."""
    lengths = F.array_repeat(norm(a), F.size(a))  # a lambda would work the length out again for each component
    return F.when((norm(a) > 0) & (norm(a) < float("inf")), F.zip_with(a, lengths, lambda x, n: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))
