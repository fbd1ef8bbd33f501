"""Vector expressions over array columns; all of them are Spark expressions, without Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def sq_euclidean(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def euclidean(a: Column, b: Column) -> Column:
    """V1."""
    return F.sqrt(sq_euclidean(a, b))


def cityblock(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


METRICS = {"euclidean": euclidean, "sqeuclidean": sq_euclidean, "cityblock": cityblock, "cosine": cosine}


def l2_normalize(v: Column) -> Column:
    """V over its norm; null for a zero vector."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm))


def zero_fill(v: Column, dim: int) -> Column:
    """A zero vector for null."""
    return F.coalesce(v, F.array_repeat(F.lit(0.0), dim))


def truncate(v: Column, n: int) -> Column:
    """the first n dimensions."""
    return F.slice(v, 1, n)


def mean_vectors(df: DataFrame, by: str, vector: str = "vector", weight: Column | None = None) -> DataFrame:
    """(by, vector, n): the weighted mean of each group's vectors; nulls are left out. Sums are partial before the shuffle."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    flat = df.filter(F.col(vector).isNotNull()).select(by, w.alias("w"), F.posexplode(vector).alias("pos", "x"))
    sums = flat.groupBy(by, "pos").agg(F.sum(F.col("w") * F.col("x").cast("double")).alias("s"), F.sum("w").alias("n"))
    listed = sums.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("pos", "s"))).alias("v"), F.max("n").alias("n"))  # one entry per dimension
    return listed.filter("n > 0").select(by, F.transform("v", lambda x: x["s"] / F.col("n")).alias("vector"), "n")
