"""Vector arithmetic over array<float|double> columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is null or zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def normalised(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 where both are empty."""
    n = F.size(F.array_union(a, b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(0.0)


def clamp01(x: Column, low: Column, high: Column) -> Column:
    """Position of ``x`` between two bounds, within 0 and 1; equal bounds give 0, null stays null."""
    return F.when(x.isNull(), F.lit(None).cast("double")).when(high > low, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / (high - low)))).otherwise(0.0)


def hashed_counts(tokens: Column, dim: int = 64) -> Column:
    """Words counted in ``dim`` buckets by hash: a deterministic stand-in for an embedding model, without meaning."""
    bucket = F.transform(tokens, lambda t: F.conv(F.substring(F.md5(t), 1, 4), 16, 10).cast("int") % dim)
    return F.aggregate(bucket, F.array_repeat(F.lit(0.0), dim), lambda counts, b: F.transform(counts, lambda n, i: F.when(i == b, n + 1.0).otherwise(n)))
