"""Reproducible shipments, inventory snapshots and forecasts from dimension tables.

Every value is a function of (seed, row keys), so rows can be made anywhere and remade after
a lost task. Products are paired with warehouses (or regions) first, pairs are sampled and
spread over the cluster, and only then unfolded over the dates inside their task: the one
shuffle before the unfolding moves pairs, which are fewer than rows by the number of dates.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import error_pct, noise_fraction, noise_int, padded_key
from ..operators.pairing import pair_up, shuffle_width
from ..operators.ranking import global_rank, range_bucket, range_cuts
from .contracts import FORECASTS, INVENTORY, SHIPMENTS, conform
from .sample import (
    PROFILES,
    SEED,
    CategoryProfile,
    Seasonal,
    sample_products,
    sample_warehouses,
)
from .spines import with_dates, with_weekdays, year_span

# Share of pairs kept, id offsets, status shares, model versions by month.
PAIRS_KEPT_PCT = 52
FIRST_ORDER = 10000
FIRST_CUSTOMER = 1001
CANCELLED_BELOW = 0.02
BACKORDER_BELOW = 0.05
IN_TRANSIT_BELOW = 0.08
IN_TRANSIT_AFTER = dt.date(2025, 11, 15)
MODEL_VERSIONS = ((4, "v3.0"), (8, "v3.1"), (12, "v3.2"))

GROUPS_PER_PARTITION = 4

Profiles = Sequence[CategoryProfile]


def _per_category(profiles: Profiles, value: Callable[[CategoryProfile], Column]) -> Column:
    """``value`` of the profile that a row's category has; the None profile is the default."""
    fallback = next(value(p) for p in profiles if p.category is None)
    chain = F
    for p in profiles:
        if p.category is not None:
            chain = chain.when(F.col("product_category") == p.category, value(p))
    return fallback if chain is F else chain.otherwise(fallback)


def _in_season(season: Seasonal, month: Column, lit: Callable[[Decimal], Column]) -> Column:
    chain = F
    for months, value in season.peaks:
        chain = chain.when(month.isin(*months), lit(value))
    return lit(season.usual) if chain is F else chain.otherwise(lit(season.usual))


def _decimal(value: Decimal | str) -> Column:
    """Exact literal: rates and factors must not pick up binary rounding before truncation."""
    return F.lit(Decimal(value))


def _spread(pairs: DataFrame, *keys: str) -> DataFrame:
    """Even out pairs before they unfold: a fixed width, which AQE does not merge away."""
    return pairs.repartition(shuffle_width(pairs), *keys)


def shipments(
    products: DataFrame,
    warehouses: DataFrame,
    start: dt.date,
    end: dt.date,
    seed: int = SEED,
    profiles: Profiles = PROFILES,
    customers: int = 500,
    in_transit_after: dt.date = IN_TRANSIT_AFTER,
    rank_buckets: int | None = None,
) -> DataFrame:
    """Orders: a (weekday, product, warehouse) sells with its category's seasonal chance.

    Ids number the orders by (date, sku, warehouse). ``rank_buckets`` is the number of sku
    ranges a day is cut into for that; it affects balance, never the ids, and has no ceiling.
    By default it is chosen so that there are several (day, range) groups per shuffle partition.
    One value per range comes to the driver.
    """
    keys = ("order_date", "product_sku", "warehouse_id")
    if rank_buckets is None:
        groups = GROUPS_PER_PARTITION * shuffle_width(products)
        rank_buckets = math.ceil(groups / ((end - start).days + 1))
    cuts = range_cuts(products, "product_sku", rank_buckets)
    sold = products.select(
        "product_sku",
        "product_name",
        "product_category",
        "unit_price",
        range_bucket("product_sku", cuts).alias("sku_range"),
    )
    shipped_from = warehouses.select("warehouse_id", F.col("region").alias("destination_region"))
    pairs = _spread(pair_up(sold, shipped_from, "product_sku"), "product_sku", "warehouse_id")

    month = F.month("order_date")
    rate = _per_category(
        profiles, lambda p: _in_season(p.order_rate, month, lambda v: F.lit(float(v)))
    )
    orders = with_weekdays(pairs, "order_date", start, end).where(
        noise_fraction(seed, "select_noise", *keys) < rate
    )

    amount = noise_fraction(seed, "qty_noise", *keys)
    fate = noise_fraction(seed, "status_noise", *keys)
    status = (
        F.when(fate < CANCELLED_BELOW, "Cancelled")
        .when(fate < BACKORDER_BELOW, "Backorder")
        .when(
            (fate < IN_TRANSIT_BELOW) & (F.col("order_date") > F.lit(in_transit_after)),
            "In Transit",
        )
        .otherwise("Delivered")
    )
    customer = noise_int(seed, "customer_idx", *keys, modulo=customers, offset=FIRST_CUSTOMER)
    lag = noise_int(seed, "delivery_offset", *keys, modulo=4, offset=2)
    quantity = _per_category(
        profiles, lambda p: p.quantity[0] + F.floor(amount * p.quantity[1])
    )
    ranked = global_rank(orders, "order_rank", "order_date", "sku_range", keys[1:])
    return conform(
        ranked,
        SHIPMENTS,
        {
            "order_id": padded_key("ORD-", F.col("order_rank") + FIRST_ORDER, 6),
            "customer_id": padded_key("CUST-", customer, 4),
            "quantity": quantity,
            "delivery_date": F.date_add("order_date", lag),
            "order_status": status,
        },
    )


def inventory(
    products: DataFrame,
    warehouses: DataFrame,
    start: dt.date,
    end: dt.date,
    seed: int = SEED,
    profiles: Profiles = PROFILES,
) -> DataFrame:
    """Weekly stock of the sampled (product, warehouse) pairs, from ``start`` in 7-day steps.

    The snapshot days follow from ``start``, so another first year gives other days in the
    last one too.
    """
    keys = ("snapshot_date", "product_sku", "warehouse_id")
    stocked = products.select(
        "product_sku", "product_name", "product_category",
        "unit_cost", "reorder_point", "safety_stock_qty",
    )
    stores = warehouses.select("warehouse_id", "warehouse_name", "lead_time_days")
    pairs = pair_up(stocked, stores, "product_sku").where(
        noise_int(seed, "inventory_pair", *keys[1:], modulo=100) < PAIRS_KEPT_PCT
    )
    snapshots = with_dates(_spread(pairs, *keys[1:]), "snapshot_date", start, end, "week")

    reorder = F.col("reorder_point")
    phase = F.pmod(F.hash("product_sku"), F.lit(100))
    wave = F.sin(
        F.dayofyear("snapshot_date") * _decimal("3.14159") / _decimal("180.0") + phase
    )
    jitter = noise_fraction(seed, "inventory_noise", *keys) - _decimal("0.5")
    dip = _per_category(
        profiles, lambda p: _in_season(p.stock_dip, F.month("snapshot_date"), _decimal)
    )
    level = (
        reorder * _decimal("1.8")
        + reorder * _decimal("0.6") * wave
        + reorder * _decimal("0.3") * jitter
        - reorder * dip
    )
    return conform(
        snapshots,
        INVENTORY,
        {
            "quantity_on_hand": F.greatest(F.lit(0), level.cast("int")),
            "lead_time_days": F.col("lead_time_days")
            + noise_int(seed, "lead_delta", *keys, modulo=3, offset=-1),
        },
    )


def forecasts(
    products: DataFrame,
    regions: DataFrame,
    start: dt.date,
    end: dt.date,
    seed: int = SEED,
    profiles: Profiles = PROFILES,
) -> DataFrame:
    """Monthly forecast, range and actual of the sampled (product, region) pairs."""
    keys = ("forecast_date", "product_sku", "region")
    pairs = pair_up(
        products.select("product_sku", "product_name", "product_category"),
        regions.select("region"),
        "product_sku",
    ).where(noise_int(seed, "forecast_pair", *keys[1:], modulo=100) < PAIRS_KEPT_PCT)
    months = with_dates(_spread(pairs, *keys[1:]), "forecast_date", start, end, "month")

    month = F.month("forecast_date")
    version = F.lit(MODEL_VERSIONS[-1][1])
    for last_month, name in reversed(MODEL_VERSIONS[:-1]):
        version = F.when(month <= last_month, name).otherwise(version)
    trend = _decimal("1.0") + _decimal("0.03") * month
    season = _per_category(profiles, lambda p: _in_season(p.demand_season, month, _decimal))
    units = _per_category(profiles, lambda p: F.lit(p.demand))

    def scaled(units: Column, low: str, width: str, salt: str) -> Column:
        share = _decimal(low) + _decimal(width) * noise_fraction(seed, salt, *keys)
        return (units * share).cast("int")

    predicted = F.col("predicted_demand")
    filled = (
        months.withColumn(
            "predicted_demand", scaled(units * trend * season, "0.85", "0.30", "forecast_noise")
        )
        .withColumns(
            {
                "confidence_lower": scaled(predicted, "0.82", "0.03", "lower_noise"),
                "confidence_upper": scaled(predicted, "1.12", "0.05", "upper_noise"),
                "actual_demand": scaled(predicted, "0.88", "0.24", "actual_noise"),
            }
        )
    )
    return conform(
        filled, FORECASTS, {"forecast_error_pct": error_pct(), "model_version": version}
    )


def sample_tables(
    spark: SparkSession, seed: int = SEED, scale: int = 1
) -> dict[str, DataFrame]:
    """The three tables over the sample dimensions for ``scale`` years, by table name."""
    start, end = year_span(scale)
    products, warehouses = sample_products(spark), sample_warehouses(spark)
    return {
        SHIPMENTS.table: shipments(products, warehouses, start, end, seed),
        INVENTORY.table: inventory(products, warehouses, start, end, seed),
        FORECASTS.table: forecasts(
            products, warehouses.select("region").distinct(), start, end, seed
        ),
    }
