"""All (left, right) pairs of two dimension tables as an equi-join."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

_CELL = "__cell"


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def pair_up(left: DataFrame, right: DataFrame, key: str, cells: int | None = None) -> DataFrame:
    """Each row of ``left`` with each row of ``right``.

    ``left`` is cut into ``cells`` even parts by a hash of ``key`` and ``right`` is copied
    to each part; the two then meet in an ordinary equi-join on the part number. Spark
    picks the strategy from the measured size: a broadcast hash join while one side is
    under its threshold, else a sort-merge join of ``cells`` independent parts, each of
    which reads its share of ``left`` and the whole of ``right``, as a stream. There is no
    cartesian plan. Part ``k`` is placed in partition ``k`` (a hash of the part number
    leaves a third of the partitions empty), in a fixed width: dimension tables are small
    enough for AQE to merge them into one task, but their pairs are not.
    """
    cells = cells or shuffle_width(left)
    cut = left.withColumn(_CELL, F.pmod(F.hash(key), F.lit(cells)))
    copied = right.withColumn(_CELL, F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    return (
        cut.repartitionById(cells, _CELL)
        .join(copied.repartitionById(cells, _CELL), _CELL)
        .drop(_CELL)
    )
