"""Order-dependent primitives that no single key can overload.

A window over a whole conversation puts it into one task. Here, rows are dealt out by conversation and a range of their
order; what must pass from one range to the next is a row, or a sum, for each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE = 1 << 16


def dense_seq(rows: DataFrame, key: str, order: str, name: str = "seq", width: int = RANGE) -> DataFrame:
    """Numbers the rows of each key from 0 along an integer order column, without gaps."""
    dealt = rows.withColumn("__range", F.floor(F.col(order) / width))
    counts = dealt.groupBy(key, "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(key, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(key, "__range").orderBy(order)
    numbered = dealt.withColumn("__row", F.row_number().over(inside))
    return numbered.join(starts, [key, "__range"]).withColumn(name, (F.col("__before") + F.col("__row") - 1).cast("long")).drop("__range", "__row", "__before")


def numbered_in_parts(rows: DataFrame, key: str, part: str, order: list[str], name: str) -> DataFrame:
    """Numbers the rows of each key from 0 in the given order, in which the integer column `part` never falls: parts are numbered apart, then moved by the counts before them."""
    counts = rows.groupBy(key, part).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(key, part, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(key, part).orderBy(*order)
    numbered = rows.withColumn("__row", F.row_number().over(inside)).join(starts, [key, part])
    return numbered.withColumn(name, (F.col("__before") + F.col("__row") - 1).cast("long")).drop("__row", "__before")


def with_previous(rows: DataFrame, key: str, seq: str, columns: dict[str, Column], width: int = RANGE) -> DataFrame:
    """Adds the values that the given expressions have in the row before (dense seq): the last row of a range also goes to the next one."""
    range_ = F.floor(F.col(seq) / width)
    copies = F.when(F.pmod(F.col(seq), F.lit(width)) == width - 1, F.array(range_, range_ + 1)).otherwise(F.array(range_))
    dealt = rows.select("*", F.posexplode(copies).alias("__copy", "__range"))
    inside = Window.partitionBy(key, "__range").orderBy(seq)
    out = dealt.select("*", *[F.lag(expr).over(inside).alias(name) for name, expr in columns.items()])
    return out.filter("__copy = 0").drop("__copy", "__range")


def running_sum(rows: DataFrame, key: str, seq: str, value: Column, name: str, width: int = RANGE) -> DataFrame:
    """Adds the sum of an expression up to and with each row: ranges are summed apart, then moved by the sums before them."""
    dealt = rows.withColumn("__range", F.floor(F.col(seq) / width)).withColumn("__value", value)
    sums = dealt.groupBy(key, "__range").agg(F.sum("__value").alias("__s"))
    before = Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(key, "__range", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(key, "__range").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumn("__inside", F.sum("__value").over(inside))
    return summed.join(starts, [key, "__range"]).withColumn(name, F.col("__before") + F.col("__inside")).drop("__range", "__value", "__inside", "__before")
