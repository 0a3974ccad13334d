"""Dense and sparse vector arithmetic as column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """The inner product; 0 where the lengths differ or a vector is null or empty."""
    s = F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), s).otherwise(0.0)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_double(a), F.lit(0.0), lambda acc, x: acc + x * x))


def normalize(a: Column) -> Column:
    """A10: the vector at length 1; null for null, empty and zero vectors."""
    n = norm(a)
    return F.when((F.size(a) > 0) & (n > 0), F.transform(_double(a), lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    """0 for unequal lengths, empty and zero vectors; within [-1, 1]."""
    n = norm(a) * norm(b)
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (n > 0)  # least and greatest skip nulls, so nulls go first
    return F.when(usable, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / F.nullif(n, F.lit(0.0))))).otherwise(0.0)


def sparse_dot(ai: Column, av: Column, bi: Column, bv: Column) -> Column:
    """The inner product of two sparse vectors with ascending indices, each in one row."""
    b = F.map_from_arrays(bi, _double(bv))
    return F.aggregate(F.zip_with(ai, _double(av), lambda i, v: v * F.coalesce(F.try_element_at(b, i), F.lit(0.0))), F.lit(0.0), lambda acc, x: acc + x)
