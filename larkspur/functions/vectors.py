"""Vector expressions on ARRAY<FLOAT> columns, computed in double precision inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; NULL where a vector is all zeros, as no direction is."""
    return dot(a, b) / F.nullif((norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b), F.lit(0.0))


def cosine_or_zero(a: Column, b: Column) -> Column:
    """Cosine similarity with norm 0 taken as 1, so that zero vectors score 0."""
    one = lambda n: F.when(n == 0, 1.0).otherwise(n)
    return dot(a, b) / (one(norm(a)) * one(norm(b)))


def truncate(a: Column, dims: int) -> Column:
    """The first ``dims`` components, scaled to length 1."""
    head = F.slice(a, 1, dims)
    length = norm(head)
    return F.when(length > 0, F.transform(head, lambda x: x.cast("double") / length)).otherwise(F.transform(head, lambda x: x.cast("double")))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))
