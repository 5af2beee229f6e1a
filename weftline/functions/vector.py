"""Vector expressions over array<double>; they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, zero: float | None = 0.0) -> Column:
    """Cosine similarity; ``zero`` is the result where a vector has no length."""
    c = F.try_divide(dot(a, b), norm(a) * norm(b))
    return c if zero is None else F.coalesce(c, F.lit(zero))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, d: s + d * d))


def compare(a: Column, b: Column, method: str = "cosine similarity") -> Column:
    if method == "cosine similarity":
        return cosine(a, b)
    if method == "linear kernel":
        return dot(a, b)
    if method == "euclidean distance":
        return euclidean(a, b)
    if method == "cosine distance":
        return 1 - cosine(a, b)
    raise ValueError(f"{method} not known")


def scaled(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") * by)


def added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def sum_of(vectors: Column) -> Column:
    """Element-wise sum of array<array<double>>; null if there are none."""
    first = F.transform(F.get(vectors, F.lit(0)), lambda x: x.cast("double"))
    return F.aggregate(F.slice(vectors, F.lit(2), F.greatest(F.size(vectors) - 1, F.lit(0))), first, lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))


def mean_of(vectors: Column) -> Column:
    return F.when(F.size(vectors) > 0, scaled(sum_of(vectors), F.lit(1.0) / F.size(vectors)))
