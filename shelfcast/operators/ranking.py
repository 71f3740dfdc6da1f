"""A gap-free global rank without a single-task window.

``row_number() over (order by a, b, c)`` sends every row to one task. Here the rows are cut
into ordered groups (leading date, range bucket); a group's first number is the size of all
groups before it, and numbering inside a group is a window over that group alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from .ranges import range_bucket, range_cuts

__all__ = ["global_rank", "range_bucket", "range_cuts"]


def global_rank(
    df: DataFrame, name: str, lead: str, bucket: str, order: Sequence[str]
) -> DataFrame:
    """1-based rank of ``df`` by (lead, bucket, *order), added as ``name``.

    ``bucket`` must not decrease along ``order`` within one ``lead`` value. The only global
    window runs over the group sizes: one narrow row per (lead, bucket), so the distinct
    ``lead`` values (days of a calendar, say) must be few; the rows of ``df`` may be many.
    Neither ``lead`` nor ``bucket`` may be NULL.

    ``df`` is made once: one exchange lays its rows out by group, and both the numbering and the
    group sizes read it. Spark shares an exchange only between readers of the same columns, so
    the sizes carry a checksum of whole rows; ``df`` therefore has no columns of map type.
    """
    # stated for both readers: Spark would infer it from the join for one of them alone
    known = F.col(lead).isNotNull() & F.col(bucket).isNotNull()
    laid = df.where(known).repartition(lead, bucket)
    sizes = laid.groupBy(lead, bucket).agg(
        F.count(F.lit(1)).alias("__n"), F.bit_xor(F.xxhash64(*df.columns)).alias("__rows")
    )
    up_to = F.sum("__n").over(Window.orderBy(lead, bucket))
    offsets = (
        sizes.select(lead, bucket, "__rows", (up_to - F.col("__n")).alias("__offset"))
        .where(F.col("__rows").isNotNull())
        .drop("__rows")
    )
    inside = F.row_number().over(Window.partitionBy(lead, bucket).orderBy(*order))
    return (
        laid.withColumn("__inside", inside)
        # by merge: both sides look alike in size to Spark, so it may broadcast the rows, not the offsets
        .join(offsets.hint("merge"), [lead, bucket])
        .withColumn(name, F.col("__offset") + F.col("__inside"))
        .drop("__offset", "__inside")
    )
