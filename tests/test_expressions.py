import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import tuples
from shelfcast.functions import (
    accuracy_pct,
    demand_variance,
    error_pct,
    month_start,
    padded_key,
    quarter_start,
    safe_div,
    stock_status_3,
    stock_status_4,
)


def test_safe_div_is_null_on_zero_and_null(spark):
    df = spark.createDataFrame([(6, 4), (6, 0), (6, None), (None, 4)], "a int, b int")
    assert tuples(df.select(safe_div(F.col("a"), F.col("b")))) == [(1.5,), (None,), (None,), (None,)]


def test_safe_div_on_decimals_and_doubles(spark):
    df = spark.createDataFrame([(Decimal("1.50"), 0.0)], "a decimal(10,2), b double")
    assert tuples(df.select(safe_div(F.col("a"), F.col("b")))) == [(None,)]


def test_stock_status_boundaries(spark):
    # safety 10, reorder 20: equal to a bound belongs to the level above safety, up to reorder
    df = spark.createDataFrame(
        [(q, 20, 10) for q in (0, 9, 10, 20, 21, 40, 41)],
        "quantity_on_hand int, reorder_point int, safety_stock_qty int",
    )
    assert tuples(df.select("quantity_on_hand", stock_status_3(), stock_status_4())) == [
        (0, "CRITICAL", "Critical"),
        (9, "CRITICAL", "Critical"),
        (10, "LOW", "Low"),
        (20, "LOW", "Low"),
        (21, "HEALTHY", "Healthy"),
        (40, "HEALTHY", "Healthy"),
        (41, "HEALTHY", "Overstocked"),
    ]


def test_buckets_are_dates(spark):
    df = spark.createDataFrame(
        [(dt.date(2024, 2, 29),), (dt.date(2025, 12, 31),), (dt.date(2025, 1, 1),)],
        "order_date date",
    )
    assert tuples(df.select(month_start(), quarter_start())) == [
        (dt.date(2024, 2, 1), dt.date(2024, 1, 1)),
        (dt.date(2025, 12, 1), dt.date(2025, 10, 1)),
        (dt.date(2025, 1, 1), dt.date(2025, 1, 1)),
    ]


def test_forecast_columns(spark):
    df = spark.createDataFrame(
        [(100, 90), (90, 100), (0, 5), (None, 5)], "actual_demand int, predicted_demand int"
    ).withColumn("forecast_error_pct", error_pct())
    assert tuples(df.select(demand_variance(), "forecast_error_pct", accuracy_pct())) == [
        (10, 10.0, 90.0),
        (-10, 11.1, 88.9),
        (-5, None, None),
        (None, None, None),
    ]


def test_error_ties_round_up(spark):
    # 1 of 16 is 6.25 percent, an exact tie
    df = spark.createDataFrame([(16, 17)], "actual_demand int, predicted_demand int")
    assert tuples(df.select(error_pct())) == [(6.3,)]


@pytest.mark.parametrize(
    "number, key",
    [(7, "ORD-000007"), (999999, "ORD-999999"), (1000000, "ORD-1000000"), (12345678, "ORD-12345678")],
)
def test_padded_key_never_truncates(spark, number, key):
    df = spark.createDataFrame([(number,)], "n long")
    assert tuples(df.select(padded_key("ORD-", F.col("n"), 6))) == [(key,)]
