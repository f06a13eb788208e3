"""Vector arithmetic on array columns, in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Least norm that is divided by.
FLOOR = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column) -> Column:
    """Unit vector; a zero vector stays zero."""
    n = F.greatest(norm(a), F.lit(FLOOR))
    return F.transform(a, lambda x: x.cast("double") / n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(FLOOR))
