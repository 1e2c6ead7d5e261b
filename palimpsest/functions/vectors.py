"""Column functions over vectors, hashes and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product over the shorter length, in double."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalise(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    return F.when(norm(v) == 0, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / norm(v)))


def fit_dimension(v: Column, width: int) -> Column:
    """Padded with zeros or cut to the width, then unit length."""
    return normalise(F.slice(F.concat(v.cast("array<double>"), F.array_repeat(F.lit(0.0), width)), 1, width))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over code points (those of the basic plane are UTF-16 units)."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; both empty is 0."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))
