"""The newest date of parquet files from their footers, and filters anchored at it.

``functions.newest`` reads the whole date column. A table in files says the same in the statistics
of its footers, so its anchor costs no column read, however many rows there are.
"""

from __future__ import annotations

import datetime as dt

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Settings under which Spark answers min and max from parquet footers.
_FROM_FOOTERS = {
    "spark.sql.sources.useV1SourceList": "",
    "spark.sql.parquet.aggregatePushdown": "true",
}


def newest_plan(spark: SparkSession, path: str, date: str) -> DataFrame:
    """The largest value of a column of the files at ``path``, as a plan over their footers.

    It belongs to a session of its own, so that the settings stay out of ``spark``.
    """
    side = spark.newSession()
    for key, value in _FROM_FOOTERS.items():
        side.conf.set(key, value)
    return side.read.parquet(path).agg(F.max(date).alias("newest"))


def newest_in_files(spark: SparkSession, path: str, date: str):
    """The largest value of ``date`` in the parquet files at ``path``; None where there is none.

    One value comes to the driver. Where a file has no statistics, or nothing but nulls, Spark refuses
    to answer from footers, and the column is read. Timestamps and text are always read by column, as
    Spark does not push them.
    """
    try:
        return newest_plan(spark, path, date).first()["newest"]
    except (PySparkException, Py4JJavaError):
        return spark.read.parquet(path).agg(F.max(date).alias("newest")).first()["newest"]


def latest_in_files(spark: SparkSession, path: str, date: str = "snapshot_date") -> DataFrame:
    """Rows of the latest date only; the date is a plain value, which reaches the scan.

    The files are those found when this is called. Without a date there are no rows.
    """
    anchor = newest_in_files(spark, path, date)
    return spark.read.parquet(path).where(F.col(date) == F.lit(anchor))


def trailing_months_in_files(
    spark: SparkSession, path: str, months: int, date: str = "order_date"
) -> DataFrame:
    """Rows within ``months`` calendar months of the files' latest date."""
    anchor = newest_in_files(spark, path, date)
    if isinstance(anchor, dt.datetime):
        anchor = anchor.date()
    return spark.read.parquet(path).where(F.col(date) >= F.add_months(F.lit(anchor), -months))
