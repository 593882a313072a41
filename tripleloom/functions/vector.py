"""Vector expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector stays zero."""
    n = norm(a)
    return F.transform(a.cast("array<double>"), lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))


def scaled(cosine: Column, mode: str) -> Column:
    return (1 + cosine) / 2 if mode == "normalized" else cosine


def cosine(a: Column, b: Column, mode: str = "raw") -> Column:
    """Cosine similarity; null where a vector is null or zero."""
    length = norm(a) * norm(b)
    return scaled(F.when(length > 0, dot(a, b) / length), mode)


def literal(vector: list[float]) -> Column:
    return F.split(F.lit(",".join(map(repr, map(float, vector)))), ",").cast("array<double>")
