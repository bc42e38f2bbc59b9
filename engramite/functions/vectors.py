"""Vector functions on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0.0 when either has no length."""
    length = norm(a) * norm(b)
    return F.when(length == 0, F.lit(0.0)).otherwise(F.try_divide(dot(a, b), length))


def fit_dimension(a: Column, size: int) -> Column:
    """Cut or padded with zeros."""
    return F.slice(F.concat(a.cast("array<double>"), F.array_repeat(F.lit(0.0), size)), 1, size)


def mock_embedding(text: Column, size: int) -> Column:
    """A vector of values in -1 to 1 from the bytes of the SHA-256 of a text."""
    digest = F.sha2(text, 256)
    byte = lambda i: F.conv(F.substring(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: ((byte(i) + i) % 256) / F.lit(255.0) * 2 - 1)
