"""The metric views of shipments, inventory and forecasts."""

from __future__ import annotations

from ..sources.contracts import FORECASTS, INVENTORY, SHIPMENTS
from .metrics import Measure, MetricView, distinct, mean, rows, total

DELIVERED = "order_status = 'Delivered'"


def _same(*names: str) -> dict[str, str]:
    return {name: name for name in names}


def _measures(*measures: Measure) -> dict[str, Measure]:
    return {m.name: m for m in measures}


_units = total("quantity", DELIVERED)
_orders = distinct("order_id")
_delivered = distinct("order_id", DELIVERED)

SHIPMENT_METRICS = MetricView(
    f"{SHIPMENTS.table}_metrics",
    {
        "order_date": "order_date",
        "order_month": "trunc(order_date, 'month')",
        **_same(
            "product_sku", "product_name", "product_category",
            "warehouse_id", "destination_region", "order_status",
        ),
    },
    _measures(
        Measure("total_units_shipped", "Delivered units", {"u": _units}, "{u}"),
        Measure(
            "total_revenue",
            "Value of the delivered units, USD",
            {"r": total("quantity * unit_price", DELIVERED)},
            "cast({r} as decimal(38,2))",
        ),
        Measure("total_orders", "Orders of any status", {"n": _orders}, "{n}"),
        Measure("delivered_orders", "Orders with a delivery", {"d": _delivered}, "{d}"),
        Measure(
            "fill_rate",
            "Delivered orders in percent of all",
            {"d": _delivered, "n": _orders},
            "cast({d} as double) * 100 / nullif({n}, 0)",
        ),
        Measure(
            "avg_order_size",
            "Delivered units per delivered order",
            {
                "u": total(f"case when {DELIVERED} then quantity else 0 end"),
                "d": _delivered,
            },
            "cast({u} as double) / nullif({d}, 0)",
        ),
    ),
    SHIPMENTS.time_column,
)

INVENTORY_METRICS = MetricView(
    f"{INVENTORY.table}_metrics",
    _same(
        "snapshot_date", "product_sku", "product_name", "product_category",
        "warehouse_id", "warehouse_name",
    ),
    _measures(
        Measure(
            "total_quantity_on_hand", "Units in stock", {"q": total("quantity_on_hand")}, "{q}"
        ),
        Measure(
            "total_inventory_value",
            "Cost of the units in stock, USD",
            {"v": total("quantity_on_hand * unit_cost")},
            "cast({v} as decimal(38,2))",
        ),
        Measure(
            "skus_below_reorder_point",
            "Product-warehouse rows at or below the reorder point",
            {"n": rows("quantity_on_hand <= reorder_point")},
            "{n}",
        ),
        Measure(
            "skus_below_safety_stock",
            "Product-warehouse rows below the safety stock",
            {"n": rows("quantity_on_hand < safety_stock_qty")},
            "{n}",
        ),
        Measure("avg_lead_time", "Mean lead time in days", {"d": mean("lead_time_days")}, "{d}"),
    ),
    INVENTORY.time_column,
)

FORECAST_METRICS = MetricView(
    f"{FORECASTS.table}_metrics",
    _same(
        "forecast_date", "product_sku", "product_name", "product_category",
        "model_version", "region",
    ),
    _measures(
        Measure(
            "total_predicted_demand", "Predicted units", {"p": total("predicted_demand")}, "{p}"
        ),
        Measure("total_actual_demand", "Actual units", {"a": total("actual_demand")}, "{a}"),
        Measure(
            "avg_forecast_error",
            "Mean error in percent, each forecast counting once",
            {"e": mean("forecast_error_pct")},
            "{e}",
        ),
        Measure(
            "avg_forecast_accuracy",
            "Mean of 100 minus the error",
            {"a": mean("100 - forecast_error_pct")},
            "{a}",
        ),
        Measure(
            "demand_variance",
            "Actual minus predicted units",
            {"v": total("actual_demand - predicted_demand")},
            "{v}",
        ),
        Measure("forecast_count", "Forecast rows", {"n": rows()}, "{n}"),
    ),
    FORECASTS.time_column,
)

METRIC_VIEWS = {v.name: v for v in (SHIPMENT_METRICS, INVENTORY_METRICS, FORECAST_METRICS)}
