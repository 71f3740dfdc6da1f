"""The questions as SQL table functions: ``SELECT * FROM low_fill_rate_warehouses(90)``.

A function is a parameterized query over the three tables, expanded where it is called: filters and
columns of the calling statement reach the scans. It gives the rows of the analysis of its name;
their order is the caller's, as a table has none.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import SparkSession

from ..sources.contracts import CONTRACTS
from ..sources.metric_catalog import quoted


@dataclass(frozen=True)
class TableFunction:
    """``parameters`` as in SQL; ``body`` names tables as ``{shipment_orders}`` and so on."""

    parameters: str
    body: str

    @property
    def tables(self) -> list[str]:
        return [t for t in CONTRACTS if f"{{{t}}}" in self.body]


_LATEST = "snapshot_date = (SELECT max(snapshot_date) FROM {inventory_levels})"
_LOW = f"FROM {{inventory_levels}} WHERE {_LATEST} AND quantity_on_hand <= reorder_point"
_ITEM = "product_sku, product_name, warehouse_id, warehouse_name, quantity_on_hand"
_FILL = (
    "cast(count(DISTINCT order_id) FILTER (WHERE order_status = 'Delivered') AS double) * 100 "
    "/ nullif(count(DISTINCT order_id), 0)"
)
_SUPPLY = f"""(
  SELECT stock.*, quantity_on_hand / nullif(avg_daily_demand, 0) AS days_of_supply
  FROM (SELECT * FROM {{inventory_levels}} WHERE {_LATEST}) AS stock
  LEFT JOIN (
    SELECT product_sku, warehouse_id,
           sum(quantity) / nullif(datediff(max(order_date), min(order_date)), 0) AS avg_daily_demand
    FROM {{shipment_orders}} WHERE order_status = 'Delivered' GROUP BY product_sku, warehouse_id
  ) USING (product_sku, warehouse_id)
)"""

FUNCTIONS = {
    "below_reorder": TableFunction(
        "",
        f"SELECT {_ITEM}, reorder_point, safety_stock_qty, CASE WHEN quantity_on_hand < safety_stock_qty "
        "THEN 'CRITICAL' WHEN quantity_on_hand <= reorder_point THEN 'LOW' ELSE 'HEALTHY' END AS stock_status " + _LOW,
    ),
    "reorder_by_lead_time": TableFunction(
        "", "SELECT product_sku, product_name, warehouse_name, quantity_on_hand, reorder_point, lead_time_days " + _LOW
    ),
    "inventory_value_by_warehouse": TableFunction(
        "",
        "SELECT warehouse_id, warehouse_name, cast(round(sum(quantity_on_hand * unit_cost), 2) AS decimal(38,2)) "
        f"AS total_value FROM {{inventory_levels}} WHERE {_LATEST} GROUP BY warehouse_id, warehouse_name",
    ),
    "volume_by_warehouse": TableFunction(
        "",
        "SELECT warehouse_id, sum(quantity) AS total_shipped FROM {shipment_orders} "
        "WHERE order_status = 'Delivered' GROUP BY warehouse_id",
    ),
    "recent_volume_by_warehouse": TableFunction(
        "months int DEFAULT 3",
        "SELECT warehouse_id, sum(quantity) AS total_units_shipped, count(DISTINCT order_id) AS total_orders "
        "FROM {shipment_orders} WHERE order_status = 'Delivered' AND order_date >= "
        "add_months((SELECT max(order_date) FROM {shipment_orders}), -recent_volume_by_warehouse.months) GROUP BY warehouse_id",
    ),
    "fill_rate_by_category": TableFunction(
        "", f"SELECT product_category, {_FILL} AS fill_rate FROM {{shipment_orders}} GROUP BY product_category"
    ),
    "revenue_by_region": TableFunction(
        "",
        "SELECT destination_region, cast(sum(quantity * unit_price) FILTER (WHERE order_status = 'Delivered') "
        "AS decimal(38,2)) AS total_revenue FROM {shipment_orders} GROUP BY destination_region",
    ),
    "low_fill_rate_warehouses": TableFunction(
        "below_pct double DEFAULT 95",
        f"SELECT warehouse_id, fill_rate FROM (SELECT warehouse_id, {_FILL} AS fill_rate FROM {{shipment_orders}} "
        "GROUP BY warehouse_id) WHERE fill_rate < low_fill_rate_warehouses.below_pct",
    ),
    "forecast_accuracy_by_category": TableFunction(
        "",
        "SELECT product_category, round(avg(100 - forecast_error_pct), 1) AS avg_accuracy_pct, "
        "round(avg(forecast_error_pct), 1) AS avg_error_pct, count(*) AS num_forecasts "
        "FROM {demand_forecasts} GROUP BY product_category",
    ),
    "actual_vs_forecast": TableFunction(
        "category string DEFAULT 'Electronics', from_date date DEFAULT date'2025-10-01'",
        "SELECT product_name, forecast_date, predicted_demand, actual_demand, "
        "actual_demand - predicted_demand AS variance, round(100 - forecast_error_pct, 1) AS accuracy_pct, "
        "model_version, region FROM {demand_forecasts} WHERE product_category = actual_vs_forecast.category "
        "AND forecast_date >= actual_vs_forecast.from_date",
    ),
    "days_of_supply_by_category": TableFunction(
        "",
        "SELECT product_category, round(avg(days_of_supply), 1) AS avg_days_of_supply "
        f"FROM {_SUPPLY} GROUP BY product_category",
    ),
    "stockout_risk": TableFunction(
        "",
        f"SELECT {_ITEM}, safety_stock_qty, lead_time_days, days_of_supply FROM {_SUPPLY} "
        "WHERE quantity_on_hand < safety_stock_qty OR days_of_supply < lead_time_days",
    ),
}


def register_functions(
    spark: SparkSession, tables: Mapping[str, str], schema: str | None = None, only: str | None = None
) -> list[str]:
    """Create the functions over ``tables`` (contract table name to the name of a table or view).

    Temporary ones of the session, or with ``schema`` permanent ones of that schema, which need
    permanent tables and are called after ``USE schema`` (Spark takes no schema in front of a table
    function's name); existing ones are replaced. Functions whose tables are not given are left out.
    Returns the names created. ``only``: the name of a single function.
    """
    made = []
    for name, function in FUNCTIONS.items():
        if only not in (None, name) or not set(function.tables) <= set(tables):
            continue
        body = function.body.format(**{t: quoted(n) for t, n in tables.items()})
        kind, place = ("FUNCTION", f"{schema}.{name}") if schema else ("TEMPORARY FUNCTION", name)
        spark.sql(f"CREATE OR REPLACE {kind} {quoted(place)}({function.parameters}) RETURNS TABLE RETURN {body}")
        made.append(place)
    return made
