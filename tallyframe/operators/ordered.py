"""Previous row and running total over a long ordered sequence, without one task per sequence.

A plain window sends a whole group to one task. Here the order is cut into buckets: rows look at each other inside a
bucket, buckets look at each other through a one-row summary, and the two are joined. A group that holds a third of
the table is spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A left join in which null keys meet null keys; right has one row per key."""
    renamed = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return left.join(renamed, on, "left").drop(*[f"_k_{k}" for k in keys])


def with_previous(df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: str, name: str = "previous") -> DataFrame:
    """Add the value of the row before, in the given order. `bucket` must not decrease along the order."""
    cut = df.withColumn("_b", bucket)
    inside = Window.partitionBy(*keys, "_b").orderBy(*order)
    local = cut.withColumn("_local", F.lag(F.struct(value)).over(inside))
    last = cut.groupBy(*keys, "_b").agg(F.max_by(F.struct(value), F.struct(*order)).alias("_last"))
    carried = last.withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_b"))).drop("_last")
    return _same(local, carried, [*keys, "_b"]).withColumn(name, F.coalesce("_local", "_carry")[value]).drop("_local", "_carry", "_b")


def with_running_sum(df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: Column, name: str) -> DataFrame:
    """Add the running sum of a number up to and including the row."""
    cut = df.withColumn("_b", bucket).withColumn("_v", value)
    inside = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = cut.groupBy(*keys, "_b").agg(F.sum("_v").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_b", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    local = cut.withColumn("_run", F.sum("_v").over(inside))
    return _same(local, offsets, [*keys, "_b"]).withColumn(name, F.col("_run") + F.col("_offset")).drop("_run", "_offset", "_v", "_b")
