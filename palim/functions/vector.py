"""Vector expressions over array<float>, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product; 0 where the lengths differ or a side is empty or null."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    value = F.aggregate(products, F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), value).otherwise(0.0)


def negative_dot(a: Column, b: Column) -> Column:
    return -dot(a, b)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column) -> Column:
    """Of length 1; unchanged if its length is at most 1e-12."""
    length = norm(a)
    return F.when(length <= 1e-12, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / length))


def normalize(a: Column, dim: int) -> Column:
    """Longer vectors are cut to dim and scaled; those of dim are scaled only if not of length 1 yet; shorter ones are an error."""
    length = norm(a)
    exact = F.when(F.abs(length * length - 1) > 1e-6, unit(a)).otherwise(a.cast("array<double>"))
    short = F.raise_error(F.concat(F.lit("embedding has "), F.size(a).cast("string"), F.lit(f" of {dim} dimensions"))).cast("array<double>")
    return F.when(F.size(a) < dim, short).when(F.size(a) == dim, exact).otherwise(unit(F.slice(a, 1, dim)))
