"""Expressions on ARRAY<DOUBLE> vectors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

VECTOR_SIZE = 1000


def fit_length(v: Column, n: int = VECTOR_SIZE, cut: bool = False) -> Column:
    """Pad with zeros to ``n`` elements; NULL becomes the zero vector. Longer vectors are an error, or cut on request."""
    zeros = F.array_repeat(F.lit(0.0), n)
    padded = F.slice(F.concat(v, zeros), 1, n)
    if not cut:
        padded = F.when(F.size(v) > n, F.raise_error(F.format_string(f"a vector of %d elements does not fit {n}", F.size(v))).cast("array<double>")).otherwise(padded)
    return F.when(v.isNull(), zeros).otherwise(padded)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when either vector is zero."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale).otherwise(F.lit(0.0))


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)


def vector_min(v: Column) -> Column:
    return F.array_min(v)


def vector_max(v: Column) -> Column:
    return F.array_max(v)


def vector_mean(v: Column) -> Column:
    return F.try_divide(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x), F.size(v))
