"""Vector columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0.0 where a vector is null, empty or zero, or lengths differ."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    fits = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(fits & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def resized(v: Column, dim: int) -> Column:
    """The first `dim` components at unit length; an error where there are fewer, or all are zero."""
    cut = F.transform(F.slice(v, 1, dim), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(cut, F.lit(0.0), lambda s, x: s + x * x))
    scaled = F.transform(cut, lambda x: x / norm)
    return F.when((F.size(v) >= dim) & (norm > 0), scaled).otherwise(F.raise_error(F.lit(f"no vector of {dim} dimensions")).cast("array<double>"))
