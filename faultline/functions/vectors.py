"""Vector arithmetic on arrays, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products; arrays of doubles of one length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column) -> Column:
    """SC24: L2-normalised; a zero vector stays."""
    norms = F.array_repeat(norm(a), F.size(a))  # once, not in the lambda for every element
    return F.zip_with(a, norms, lambda x, n: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """SC25; 0 with a zero vector."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def hybrid(dense: Column, sparse: Column, alpha: float = 0.55, beta: float = 0.45) -> Column:
    """SC27."""
    return alpha * dense + beta * sparse
