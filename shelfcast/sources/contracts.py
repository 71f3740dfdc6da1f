"""Typed contracts of the three fact tables and ``conform`` to bring user data into them."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    comment: str


@dataclass(frozen=True)
class Contract:
    """Name, columns and time column of one fact table."""

    table: str
    fields: tuple[Field, ...]
    time_column: str

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.fields]

    @property
    def comments(self) -> dict[str, str]:
        return {f.name: f.comment for f in self.fields}


SHIPMENTS = Contract(
    "shipment_orders",
    (
        Field("order_id", "string", "Order key; one order can span several rows"),
        Field("order_date", "date", "Day the order came in"),
        Field("customer_id", "string", "Customer key"),
        Field("product_sku", "string", "Product key (SKU)"),
        Field("product_name", "string", "Product display name"),
        Field("product_category", "string", "Category the product is sold under"),
        Field("quantity", "int", "Units on this row"),
        Field("unit_price", "decimal(10,2)", "Selling price of one unit, USD"),
        Field("warehouse_id", "string", "Distribution centre the goods leave from"),
        Field("destination_region", "string", "Region the goods are delivered to"),
        Field("delivery_date", "date", "Day of delivery, planned or done"),
        Field("order_status", "string", "One of Delivered, Backorder, In Transit, Cancelled"),
    ),
    time_column="order_date",
)

INVENTORY = Contract(
    "inventory_levels",
    (
        Field("product_sku", "string", "Product key (SKU)"),
        Field("product_name", "string", "Product display name"),
        Field("product_category", "string", "Category the product is sold under"),
        Field("warehouse_id", "string", "Distribution centre key"),
        Field("warehouse_name", "string", "Distribution centre display name"),
        Field("snapshot_date", "date", "Day the stock was counted (weekly)"),
        Field("quantity_on_hand", "int", "Units in stock at the snapshot"),
        Field("reorder_point", "int", "Stock level at which to buy again"),
        Field("safety_stock_qty", "int", "Buffer that should never be used up"),
        Field("lead_time_days", "int", "Days from purchase to arrival"),
        Field("unit_cost", "decimal(10,2)", "Purchase cost of one unit, USD"),
    ),
    time_column="snapshot_date",
)

FORECASTS = Contract(
    "demand_forecasts",
    (
        Field("product_sku", "string", "Product key (SKU)"),
        Field("product_name", "string", "Product display name"),
        Field("product_category", "string", "Category the product is sold under"),
        Field("forecast_date", "date", "Month forecast, as its first day"),
        Field("predicted_demand", "int", "Units expected in the month"),
        Field("confidence_lower", "int", "Low end of the expected range"),
        Field("confidence_upper", "int", "High end of the expected range"),
        Field("actual_demand", "int", "Units really demanded in the month"),
        Field("forecast_error_pct", "double", "Absolute miss in percent of the actual units"),
        Field("model_version", "string", "Version of the forecasting model"),
        Field("region", "string", "Region forecast for"),
    ),
    time_column="forecast_date",
)

CONTRACTS = {c.table: c for c in (SHIPMENTS, INVENTORY, FORECASTS)}


def conform(
    df: DataFrame, contract: Contract, mapping: Mapping[str, str | Column] | None = None
) -> DataFrame:
    """Select ``contract``'s columns from ``df``, cast and documented.

    ``mapping`` gives the source column or expression of a contract column; columns left
    out are taken by name. The comment rides on the column metadata, so a table written
    from the result is documented without further statements.
    """
    mapping = mapping or {}
    unknown = sorted(set(mapping) - set(contract.columns))
    if unknown:
        raise ValueError(f"{contract.table} has no columns {unknown}")
    missing = [
        f.name for f in contract.fields if f.name not in mapping and f.name not in df.columns
    ]
    if missing:
        raise ValueError(f"{contract.table}: no source given for {missing}")
    selected = []
    for field in contract.fields:
        source = mapping.get(field.name, field.name)
        column = F.col(source) if isinstance(source, str) else source
        selected.append(
            column.cast(field.type).alias(field.name, metadata={"comment": field.comment})
        )
    return df.select(*selected)
