"""Reusable filters, expressions and measures, found by display name or synonym."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from ..functions import (
    below_reorder_point,
    below_safety_stock,
    is_delivered,
    month_start,
    quarter_start,
    stock_status_4,
)


@dataclass(frozen=True)
class Snippet:
    """``build()`` gives the Column, over unqualified contract columns."""

    kind: str
    alias: str
    build: Callable[[], Column]
    names: tuple[str, ...]

    def column(self) -> Column:
        return self.build().alias(self.alias)


# Display name first, then its synonyms.
SNIPPETS = (
    Snippet(
        "filter",
        "below_reorder_point",
        below_reorder_point,
        ("below reorder point", "low stock", "needs reorder", "stockout risk"),
    ),
    Snippet(
        "filter",
        "below_safety_stock",
        below_safety_stock,
        ("below safety stock", "critical stock", "emergency", "urgent reorder"),
    ),
    Snippet(
        "filter",
        "delivered_orders",
        is_delivered,
        ("delivered orders", "completed orders", "fulfilled orders"),
    ),
    Snippet("expression", "order_month", month_start, ("month", "order month", "monthly")),
    Snippet(
        "expression", "order_quarter", quarter_start, ("quarter", "order quarter", "quarterly")
    ),
    Snippet(
        "expression",
        "stock_status",
        stock_status_4,
        ("stock status", "inventory status", "stock level classification"),
    ),
    # Unlike the metric view's measures these two count orders of every status.
    Snippet(
        "measure",
        "gross_units",
        lambda: F.sum("quantity"),
        ("total units shipped", "shipment volume", "units shipped"),
    ),
    Snippet(
        "measure",
        "gross_revenue",
        lambda: F.sum(F.col("quantity") * F.col("unit_price")).cast("decimal(38,2)"),
        ("total revenue", "revenue", "sales"),
    ),
    Snippet(
        "measure",
        "avg_forecast_accuracy",
        lambda: F.round(F.avg(100 - F.col("forecast_error_pct")), 1),
        ("average forecast accuracy", "forecast accuracy", "model accuracy"),
    ),
    Snippet(
        "measure",
        "total_inventory_value",
        lambda: F.sum(F.col("quantity_on_hand") * F.col("unit_cost")).cast("decimal(38,2)"),
        ("total inventory value", "inventory value", "stock value"),
    ),
)

_BY_NAME = {name: s for s in SNIPPETS for name in (s.alias, *s.names)}


def snippet(name: str) -> Snippet:
    """Look a snippet up by alias, display name or synonym, whatever the case."""
    try:
        return _BY_NAME[name.strip().lower()]
    except KeyError:
        raise KeyError(f"no snippet called {name!r}; known: {sorted(_BY_NAME)}") from None
