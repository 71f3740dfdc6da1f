"""Filters: row predicates as Columns, and date filters anchored at a table's own maximum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def is_weekday(date: str) -> Column:
    """Monday to Friday (``dayofweek`` counts Sunday as 1)."""
    return F.dayofweek(F.col(date)).between(2, 6)


def below_reorder_point(on_hand: str = "quantity_on_hand", reorder: str = "reorder_point") -> Column:
    """At or below the reorder point."""
    return F.col(on_hand) <= F.col(reorder)


def below_safety_stock(on_hand: str = "quantity_on_hand", safety: str = "safety_stock_qty") -> Column:
    """Strictly below the safety stock."""
    return F.col(on_hand) < F.col(safety)


def is_delivered(status: str = "order_status") -> Column:
    return F.col(status) == "Delivered"


def newest(df: DataFrame, date: str) -> Column:
    """The largest date of the whole table as an uncorrelated scalar subquery.

    It runs once, needs one column, and stays inside the plan: the comparison it is
    used in still reaches the scan (and prunes partitions of a table laid out by date).
    """
    return df.agg(F.max(date)).scalar()


def at_latest(df: DataFrame, date: str = "snapshot_date") -> DataFrame:
    """Rows of the latest date only; several rows may share it."""
    return df.where(F.col(date) == newest(df, date))


def trailing_months(df: DataFrame, months: int, date: str = "order_date") -> DataFrame:
    """Rows within ``months`` calendar months of the table's latest date.

    The anchor is the maximum over all rows of ``df``, so filter by status afterwards.
    """
    return df.where(F.col(date) >= F.add_months(newest(df, date), -months))
