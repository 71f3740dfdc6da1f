"""The most frequent values of columns with very many values, with exact counts.

Counting every value of an identifier column shuffles nearly every row. Here a fixed number of
hash buckets is counted first: a bucket's count bounds that of each value in it from above, so
only values in buckets that reach the k-th best count can be among the top k.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

#: Hash buckets of a column.
BUCKETS = 65536


def top_values(
    df: DataFrame, columns: Sequence[str], k: int = 10, buckets: int = BUCKETS
) -> DataFrame:
    """``(column_name, value, row_count)`` of the ``k`` most frequent values of each column.

    Values are compared as text and NULL is none; values with equal counts rank by their text. Exact
    for every distribution, in three reads of the columns: bucket counts, which are combined before
    they move and merge by addition; the values of each column's ``k`` fullest buckets, whose k-th
    count is a bound that the true k-th count can't be below; and the values of all buckets that
    reach this bound. What is sent to every task is at most ``buckets`` narrow rows for each
    column. The more the frequent values stand out, the less is counted by value; where all values
    are equally frequent every value is.
    """
    if k < 1 or buckets < 1:
        raise ValueError("k and buckets must be at least 1")
    pairs = (
        df.select(*[F.col(c).cast("string").alias(c) for c in columns])
        .unpivot([], list(columns), "column_name", "value")
        .where(F.col("value").isNotNull())
        .withColumn("bucket", F.pmod(F.xxhash64("value"), F.lit(buckets)).cast("int"))
    )
    counts = pairs.groupBy("column_name", "bucket").agg(F.count(F.lit(1)).alias("bucket_count"))

    fullest = _best(counts, k, F.desc("bucket_count"), F.asc("bucket"))
    sure = _best(_counted(pairs, fullest), k, F.desc("row_count"), F.asc("value"))
    # fewer than k values there: any value of any bucket may belong to the top k
    at_least = F.when(F.count(F.lit(1)) == k, F.min("row_count")).otherwise(F.lit(1))
    bounds = sure.groupBy("column_name").agg(at_least.alias("at_least"))
    possible = counts.join(bounds, "column_name").where(F.col("bucket_count") >= F.col("at_least"))
    return _best(_counted(pairs, possible), k, F.desc("row_count"), F.asc("value"))


def _counted(pairs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Exact counts of the values in the chosen buckets, of which there are ``buckets`` a column."""
    keys = F.broadcast(chosen.select("column_name", "bucket"))
    return (
        pairs.join(keys, ["column_name", "bucket"], "left_semi")
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("row_count"))
    )


def _best(df: DataFrame, k: int, *order) -> DataFrame:
    """The first ``k`` rows of each column; tasks keep their own first ``k`` before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("column_name").orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= k).drop("__rank")
