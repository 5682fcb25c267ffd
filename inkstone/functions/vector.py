"""Vector functions as Column expressions over arrays of numbers; arithmetic in double."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product, summed from the first element on."""
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector at length 1; null where it is all zero or not finite."""
    length = norm(a)
    ok = (length > 0) & ~F.isnan(length) & (length < F.lit(float("inf")))
    return F.when(ok, F.transform(a.cast("array<double>"), lambda x: x / length))


def usable(a: Column, size: int | None = None) -> Column:
    ok = a.isNotNull() & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists(a, lambda x: x != 0)
    return ok if size is None else ok & (F.size(a) == size)


def centroid(df: DataFrame, keys: list[str], vector: str, name: str = "centroid") -> DataFrame:
    """Element-wise mean per group, not brought to length 1. Sums are combined before the shuffle."""
    long = df.select(*keys, F.posexplode(vector).alias("_pos", "_x"))
    mean = long.groupBy(*keys, "_pos").agg(F.avg(F.col("_x").cast("double")).alias("_mean"))
    packed = mean.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_pos", "_mean"))).alias("_all"))
    return packed.select(*keys, F.transform("_all", lambda s: s["_mean"]).alias(name))
