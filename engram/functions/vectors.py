"""Vector algebra over array columns, in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def sq_norm(v: Column) -> Column:
    return F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x)


def norm(v: Column) -> Column:
    return F.sqrt(sq_norm(v))


def dot(a: Column, b: Column) -> Column:
    """Inner product over the places that both have."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(as_double(a), 1, n), F.slice(as_double(b), 1, n), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity, 0 if either norm is 0. Pass norms that are at hand."""
    both = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(both == 0, F.lit(0.0)).otherwise(dot(a, b) / both)


def normalize(v: Column) -> Column:
    """The unit vector; a zero vector stays."""
    n = norm(v)
    return F.when(n == 0, as_double(v)).otherwise(F.transform(as_double(v), lambda x: x / n))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def centroids(df: DataFrame, keys: Sequence[str], vector: str = "embedding", name: str = "centroid") -> DataFrame:
    """Element-wise mean per key. Keys whose vectors differ in length have none and are left out.

    The sums are by (key, place), so they are combined before the shuffle and a hot
    key is spread over its places.
    """
    parts = df.select(*keys, F.size(vector).alias("_dim"), F.posexplode(as_double(F.col(vector))).alias("_pos", "_x"))
    means = parts.groupBy(*keys, "_pos").agg(F.avg("_x").alias("_x"), F.min("_dim").alias("_low"), F.max("_dim").alias("_high"))
    joined = means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_pos", "_x"))).alias("_v"), F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    return joined.where("_low = _high").select(*keys, F.col("_v._x").alias(name))
