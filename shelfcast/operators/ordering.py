"""Whether rows come in the order they are said to come in."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def _stands_before(row: Column, other: Column, order: Sequence[tuple[str, bool]]) -> Column:
    """``row`` sorts strictly before ``other``; null is the least value, as in Spark's sorts."""
    cases, equal = [], F.lit(True)
    for name, down in order:
        low, high = (other[name], row[name]) if down else (row[name], other[name])
        less = F.coalesce(low < high, low.isNull() & high.isNotNull())
        cases.append(equal & less)
        equal = equal & row[name].eqNullSafe(other[name])
    return reduce(Column.__or__, cases)


def order_violations(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row: ``n_rows``, and ``out_of_order``, the rows that sort before the row ahead of them.

    ``order`` names columns, with a leading ``-`` for descending. Rows that tie may come in any
    order. 0 means that the rows, read partition by partition, are sorted. Each partition is
    looked through on its own; only the first and last keys of each, one row, meet in a global
    window. The keys alone are moved; ``df`` is computed once for this and once for its cuts.
    """
    if not order:
        raise ValueError("an order has a column at least")
    keys = [(c.removeprefix("-"), c.startswith("-")) for c in order]
    key = F.struct(*[F.col(c) for c, _ in keys]).alias("key")
    rows = df.select(key, F.monotonically_increasing_id().alias("at")).withColumn(
        "part", F.shiftright("at", 33)
    )
    ahead = F.lag("key").over(Window.partitionBy("part").orderBy("at"))
    inside = rows.withColumn("ahead", ahead)
    bad = F.col("ahead").isNotNull() & _stands_before(F.col("key"), F.col("ahead"), keys)
    parts = inside.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad"),
        F.min_by("key", "at").alias("key"), F.max_by("key", "at").alias("last"),
    )
    parts = parts.withColumn("ahead", F.lag("last").over(Window.orderBy("part")))
    return parts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.col("bad") + F.coalesce(bad, F.lit(False)).cast("int")), F.lit(0)).alias("out_of_order"),
    )
