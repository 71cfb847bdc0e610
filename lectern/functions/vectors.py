"""Vector columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity in double precision; 0 for different lengths, empty or zero vectors.

    Norms that are stored with the vectors save computing them again. A NaN counts as 0, so that
    rankings stay ordered.
    """
    na, nb = norm(a) if norm_a is None else norm_a, norm(b) if norm_b is None else norm_b
    bad = a.isNull() | b.isNull() | (F.size(a) != F.size(b)) | (F.size(a) == 0) | (na == 0) | (nb == 0)
    return F.when(bad, F.lit(0.0)).otherwise(F.nanvl(dot(a, b) / (na * nb), F.lit(0.0)))
