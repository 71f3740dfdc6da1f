"""Cutting a column into ordered ranges of similar size, and finding a value's range."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def range_cuts(df: DataFrame, column: str, buckets: int) -> list:
    """Up to ``buckets - 1`` values that split ``column`` into ranges of similar size.

    Returns at most ``buckets`` values to the driver, whatever the size of ``df``. The cuts
    come from sampled range partitioning; they are plain values from here on, so what is
    built on them is exact and repeatable for any cuts, which only decide its balance.
    """
    if buckets < 2:
        return []
    firsts = (
        df.select(column)
        .where(F.col(column).isNotNull())
        .repartitionByRange(buckets, column)
        .groupBy(F.spark_partition_id())
        .agg(F.min(column).alias("first"))
        .collect()
    )
    return sorted(r["first"] for r in firsts)[1:]


def range_bucket(column: str, cuts: Sequence) -> Column:
    """Number of cuts at or below the value: an order-preserving bucket; NULL for NULL.

    The cuts are looked up in two levels, so a value is compared with about twice the square
    root of their number.
    """
    if not cuts:
        return F.when(F.col(column).isNotNull(), F.lit(0))
    width = math.isqrt(len(cuts) - 1) + 1
    groups = [cuts[i : i + width] for i in range(0, len(cuts), width)]

    def at_or_below(values: Column) -> Column:
        return F.size(F.filter(values, lambda cut: cut <= F.col(column)))

    heads = at_or_below(F.array(*[F.lit(g[0]) for g in groups]))
    inner = F.array(*[F.array(*[F.lit(c) for c in g]) for g in groups])
    found = (heads - 1) * width + at_or_below(F.element_at(inner, F.greatest(heads, F.lit(1))))
    return F.when(F.col(column).isNotNull(), F.when(heads > 0, found).otherwise(0))
