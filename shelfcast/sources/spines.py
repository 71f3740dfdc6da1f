"""Date spines: every day, seventh day or first of month between two dates, both included."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

STEPS = {
    "day": "interval 1 day",
    "week": "interval 7 day",
    "month": "interval 1 month",
}


def date_array(start: dt.date, end: dt.date, step: str) -> Column:
    return F.sequence(F.lit(start), F.lit(end), F.expr(STEPS[step]))


def with_dates(
    df: DataFrame, name: str, start: dt.date, end: dt.date, step: str
) -> DataFrame:
    """Every row of ``df`` once per date.

    The spine is unfolded inside the row, so crossing rows with dates needs neither a
    join nor a shuffle and keeps the partitioning of ``df``.
    """
    return df.withColumn(name, F.explode(date_array(start, end, step)))


def with_weekdays(df: DataFrame, name: str, start: dt.date, end: dt.date) -> DataFrame:
    """Every row of ``df`` once per Monday to Friday; the days of a weekend are never made."""
    week = [start + dt.timedelta(days=i) for i in range(7)]
    firsts = [day for day in week if day.weekday() < 5 and day <= end]
    if not firsts:
        return df.withColumn(name, F.lit(start)).where(F.lit(False))
    return df.withColumn(name, F.explode(F.concat(*[date_array(day, end, "week") for day in firsts])))


def date_spine(
    spark: SparkSession, name: str, start: dt.date, end: dt.date, step: str
) -> DataFrame:
    """The spine alone, as a one-column DataFrame."""
    return spark.range(1).select(F.explode(date_array(start, end, step)).alias(name))


def year_span(scale: int = 1, last_year: int = 2025) -> tuple[dt.date, dt.date]:
    """First and last day of ``scale`` calendar years ending with ``last_year``."""
    if scale < 1:
        raise ValueError("scale must be >= 1")
    return dt.date(last_year - scale + 1, 1, 1), dt.date(last_year, 12, 31)
