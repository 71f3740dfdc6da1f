"""The named analyses: each takes contract-shaped DataFrames and returns a lazy DataFrame.

Sorted lists end their sort keys with the row's own key. Ties then have a fixed order, and
the range partitioning behind the sort can cut through a value that many rows share (empty
shelves, say), which it could not with the value as the only key.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from ..functions import (
    accuracy_pct,
    at_latest,
    below_reorder_point,
    below_safety_stock,
    demand_variance,
    is_delivered,
    safe_div,
    stock_status_3,
    trailing_months,
)
from ..operators.views import SHIPMENT_METRICS

PAIR = ["product_sku", "warehouse_id"]


def below_reorder(inventory: DataFrame) -> DataFrame:
    """Latest stock at or below its reorder point, emptiest first in relation to that point."""
    low = at_latest(inventory).where(below_reorder_point())
    ratio = safe_div(F.col("quantity_on_hand"), F.col("reorder_point"))
    return low.orderBy(ratio, *PAIR).select(
        "product_sku",
        "product_name",
        "warehouse_id",
        "warehouse_name",
        "quantity_on_hand",
        "reorder_point",
        "safety_stock_qty",
        stock_status_3().alias("stock_status"),
    )


def below_reorder_brief(inventory: DataFrame) -> DataFrame:
    """The same rows without safety stock and status, fewest units first."""
    low = at_latest(inventory).where(below_reorder_point())
    return low.select(
        "product_sku",
        "product_name",
        "warehouse_id",
        "warehouse_name",
        "quantity_on_hand",
        "reorder_point",
    ).orderBy("quantity_on_hand", *PAIR)


def reorder_by_lead_time(inventory: DataFrame) -> DataFrame:
    """What to buy today: longest lead time first, then fewest units."""
    low = at_latest(inventory).where(below_reorder_point())
    return low.select(
        "product_sku",
        "product_name",
        "warehouse_name",
        "quantity_on_hand",
        "reorder_point",
        "lead_time_days",
    ).orderBy(
        F.desc("lead_time_days"), F.asc("quantity_on_hand"), "product_sku", "warehouse_name"
    )


def inventory_value_by_warehouse(inventory: DataFrame) -> DataFrame:
    """Cost of the latest stock of each warehouse."""
    worth = F.sum(F.col("quantity_on_hand") * F.col("unit_cost"))
    return (
        at_latest(inventory)
        .groupBy("warehouse_id", "warehouse_name")
        .agg(F.round(worth, 2).cast("decimal(38,2)").alias("total_value"))
        .orderBy(F.desc("total_value"))
    )


def volume_by_warehouse(shipments: DataFrame) -> DataFrame:
    """Delivered units of each warehouse over all time."""
    return (
        shipments.where(is_delivered())
        .groupBy("warehouse_id")
        .agg(F.sum("quantity").alias("total_shipped"))
        .orderBy(F.desc("total_shipped"))
    )


def recent_volume_by_warehouse(shipments: DataFrame, months: int = 3) -> DataFrame:
    """Delivered units and orders of each warehouse in the last ``months`` months."""
    recent = SHIPMENT_METRICS.on(trailing_months(shipments, months))
    return recent.query(
        ["total_units_shipped", "delivered_orders"],
        by=["warehouse_id"],
        where=is_delivered(),
        order_by=["-total_units_shipped"],
    ).withColumnRenamed("delivered_orders", "total_orders")


def fill_rate_by_category(shipments: DataFrame) -> DataFrame:
    return SHIPMENT_METRICS.on(shipments).query(
        ["fill_rate"], by=["product_category"], order_by=["fill_rate"]
    )


def revenue_by_region(shipments: DataFrame) -> DataFrame:
    return SHIPMENT_METRICS.on(shipments).query(
        ["total_revenue"], by=["destination_region"], order_by=["-total_revenue"]
    )


def low_fill_rate_warehouses(shipments: DataFrame, below_pct: float = 95) -> DataFrame:
    """Warehouses that deliver less than ``below_pct`` percent of their orders."""
    return SHIPMENT_METRICS.on(shipments).query(
        ["fill_rate"],
        by=["warehouse_id"],
        having=F.col("fill_rate") < below_pct,
        order_by=["fill_rate"],
    )


def forecast_accuracy_by_category(forecasts: DataFrame) -> DataFrame:
    """Mean accuracy and error (one decimal) and number of forecasts, most accurate first."""
    error = F.col("forecast_error_pct")
    return (
        forecasts.groupBy("product_category")
        .agg(
            F.round(F.avg(100 - error), 1).alias("avg_accuracy_pct"),
            F.round(F.avg(error), 1).alias("avg_error_pct"),
            F.count(F.lit(1)).alias("num_forecasts"),
        )
        .orderBy(F.desc("avg_accuracy_pct"))
    )


def forecast_accuracy_brief(forecasts: DataFrame) -> DataFrame:
    """Mean accuracy alone."""
    return (
        forecasts.groupBy("product_category")
        .agg(F.round(F.avg(100 - F.col("forecast_error_pct")), 1).alias("accuracy_pct"))
        .orderBy(F.desc("accuracy_pct"))
    )


def actual_vs_forecast(
    forecasts: DataFrame, category: str = "Electronics", from_date: dt.date = dt.date(2025, 10, 1)
) -> DataFrame:
    """Forecast against actual of one category from a date on, with variance and accuracy."""
    return (
        forecasts.where(
            (F.col("product_category") == category) & (F.col("forecast_date") >= F.lit(from_date))
        )
        .select(
            "product_name",
            "forecast_date",
            "predicted_demand",
            "actual_demand",
            demand_variance().alias("variance"),
            accuracy_pct().alias("accuracy_pct"),
            "model_version",
            "region",
        )
        .orderBy("forecast_date", "product_name", "region")
    )


def daily_demand(shipments: DataFrame) -> DataFrame:
    """Delivered units per day of each (product, warehouse).

    The days run from the first to the last order date, not counting the last; a pair with a
    single order date has no rate (NULL).
    """
    days = F.datediff(F.max("order_date"), F.min("order_date"))
    return (
        shipments.where(is_delivered())
        .groupBy(*PAIR)
        .agg(safe_div(F.sum("quantity"), days).alias("avg_daily_demand"))
    )


def days_of_supply(inventory: DataFrame, shipments: DataFrame) -> DataFrame:
    """Latest stock with ``days_of_supply``, NULL where demand is unknown.

    Demand is down to one row per pair before the join, so the join moves no order rows and
    a pair with most of the orders is one row like any other.
    """
    return (
        at_latest(inventory)
        .join(daily_demand(shipments), PAIR, "left")
        .withColumn(
            "days_of_supply", safe_div(F.col("quantity_on_hand"), F.col("avg_daily_demand"))
        )
    )


def days_of_supply_by_category(inventory: DataFrame, shipments: DataFrame) -> DataFrame:
    """Mean days of supply, one decimal; pairs without known demand do not count."""
    return (
        days_of_supply(inventory, shipments)
        .groupBy("product_category")
        .agg(F.round(F.avg("days_of_supply"), 1).alias("avg_days_of_supply"))
        .orderBy("avg_days_of_supply")
    )


def stockout_risk(inventory: DataFrame, shipments: DataFrame) -> DataFrame:
    """Latest stock below safety stock, or used up before a purchase could arrive."""
    runs_out = F.col("days_of_supply") < F.col("lead_time_days")
    return (
        days_of_supply(inventory, shipments)
        .where(below_safety_stock() | runs_out)
        .select(
            "product_sku",
            "product_name",
            "warehouse_id",
            "warehouse_name",
            "quantity_on_hand",
            "safety_stock_qty",
            "lead_time_days",
            "days_of_supply",
        )
        .orderBy("days_of_supply", *PAIR)
    )
