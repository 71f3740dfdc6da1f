"""The three contracts over the order-processing test tables (lineitem, orders, part, ...).

A query names the contract columns it uses; only the tables behind those columns are joined,
since dropping an unused column does not make Spark drop the join it came from. Dimension
joins are left joins: a row is not lost because a dimension row is missing.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import error_pct, padded_key
from ..operators.ranking import global_rank
from .contracts import FORECASTS, INVENTORY, SHIPMENTS, conform
from .spines import with_dates
from .tables import parquet_table

FIRST_SNAPSHOT = dt.date(2001, 6, 6)
SNAPSHOTS = 8
STORES_PER_PART = 4
KEYS_IN_RANGE = 1 << 16


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def _region_of_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = parquet_table(spark, sf_dir, "nation")
    region = parquet_table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey, "left").select(
        "n_nationkey", "r_regionkey", "r_name"
    )


def order_lines(
    spark: SparkSession, sf_dir: str, part: bool = False, region: bool = False
) -> DataFrame:
    """lineitem with its order and, if asked for, the part and the customer's region.

    The region is looked up per order, before orders meet their several lines.
    """
    orders = parquet_table(spark, sf_dir, "orders")
    if region:
        customer = parquet_table(spark, sf_dir, "customer")
        nations = _region_of_nation(spark, sf_dir)
        located = customer.join(
            nations, customer.c_nationkey == nations.n_nationkey, "left"
        ).select("c_custkey", "r_regionkey", "r_name")
        orders = orders.join(located, orders.o_custkey == located.c_custkey, "left")
    lines = parquet_table(spark, sf_dir, "lineitem")
    lines = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    if part:
        # by merge: a small compressed file can hold millions of parts, which Spark would broadcast
        parts = parquet_table(spark, sf_dir, "part").hint("merge")
        lines = lines.join(parts, lines.l_partkey == parts.p_partkey, "left")
    return lines


def shipments(
    spark: SparkSession, sf_dir: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """One shipment row per order line; ``columns`` narrows the result and its joins."""
    columns = list(columns or SHIPMENTS.columns)
    from_part = {"product_name", "product_category", "unit_price"}
    lines = order_lines(
        spark,
        sf_dir,
        part=bool(from_part & set(columns)),
        region="destination_region" in columns,
    )
    partial = F.col("o_orderstatus") == "P"
    status = (
        F.when(partial & (F.col("l_returnflag") == "R"), "Cancelled")
        .when(partial, "Backorder")
        .when(
            (F.col("o_orderstatus") == "O") & (F.col("l_linestatus") == "O"), "In Transit"
        )
        .otherwise("Delivered")
    )
    sources = {
        "order_id": padded_key("ORD-", F.col("l_orderkey"), 9),
        "order_date": F.col("o_orderdate"),
        "customer_id": F.col("o_custkey"),
        "product_sku": F.col("l_partkey"),
        "product_name": F.col("p_name"),
        "product_category": F.col("p_type"),
        "quantity": F.col("l_quantity"),
        "unit_price": F.col("p_retailprice"),
        "warehouse_id": F.col("l_suppkey"),
        "destination_region": F.col("r_name"),
        "delivery_date": F.col("l_shipdate"),
        "order_status": status,
    }
    types = {f.name: f.type for f in SHIPMENTS.fields}
    return lines.select(*[sources[c].cast(types[c]).alias(c) for c in columns])


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight weekly snapshots of each part in four of the suppliers' stores.

    Suppliers are numbered by their keys, one row each, so gaps between keys lose no rows.
    """
    part = parquet_table(spark, sf_dir, "part")
    supplier = parquet_table(spark, sf_dir, "supplier")
    known = supplier.where(F.col("s_suppkey").isNotNull())
    # a range of key values holds at most as many suppliers, and takes no job to find
    ranges = {"__all": F.lit(0), "__range": F.floor(F.col("s_suppkey") / KEYS_IN_RANGE)}
    numbered = global_rank(known.withColumns(ranges), "__number", "__all", "__range", ["s_suppkey"])
    stores = known.agg(F.count(F.lit(1)).cast("bigint")).scalar()
    step = F.expr(f"__stores div {STORES_PER_PART}")
    # by merge: Spark's size of the parts leaves out their unfolding, so it would broadcast them
    stocked = (
        part.withColumn("__stores", stores)
        .withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(STORES_PER_PART - 1))))
        .withColumn("__store", (F.col("p_partkey") + F.col("__i") * step) % F.col("__stores"))
        .hint("merge")
        .join(numbered, F.col("__store") == F.col("__number") - 1)
    )
    last = FIRST_SNAPSHOT + dt.timedelta(weeks=SNAPSHOTS - 1)
    weekly = with_dates(stocked, "snapshot_date", FIRST_SNAPSHOT, last, "week").withColumns(
        {
            "reorder_point": 20 + 4 * F.col("p_size"),
            "safety_stock_qty": 10 + 2 * F.col("p_size"),
            "__week": F.expr(f"datediff(snapshot_date, date'{FIRST_SNAPSHOT}') div 7"),
        }
    )
    mixed = 31 * F.col("p_partkey") + 17 * F.col("s_suppkey") + 13 * F.col("__week")
    return conform(
        weekly,
        INVENTORY,
        {
            "product_sku": _text("p_partkey"),
            "product_name": "p_name",
            "product_category": "p_type",
            "warehouse_id": _text("s_suppkey"),
            "warehouse_name": "s_name",
            "quantity_on_hand": mixed % (4 * F.col("reorder_point")),
            "lead_time_days": 4 + F.col("s_suppkey") % 4,
            "unit_cost": "p_retailprice",
        },
    )


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly demand of each (brand and type, region) with a derived prediction."""
    lines = order_lines(spark, sf_dir, part=True, region=True)
    monthly = lines.groupBy(
        F.concat_ws("/", "p_brand", "p_type").alias("product_sku"),
        F.col("p_type").alias("product_category"),
        F.col("r_name").alias("region"),
        "r_regionkey",
        F.trunc(F.col("o_orderdate").cast("date"), "month").alias("forecast_date"),
    ).agg(F.sum("l_quantity").cast("int").alias("actual_demand"))
    month = F.month("forecast_date")
    predicted = (
        monthly.withColumn("__bias", 88 + (7 * month + 5 * F.col("r_regionkey")) % 25)
        .withColumn("predicted_demand", F.expr("cast(bigint(actual_demand) * __bias div 100 as int)"))
    )
    version = (
        F.when(month <= 4, "v3.0").when(month <= 8, "v3.1").otherwise("v3.2")
    )
    return conform(
        predicted,
        FORECASTS,
        {
            "product_name": "product_sku",
            "confidence_lower": F.expr("bigint(predicted_demand) * 83 div 100"),
            "confidence_upper": F.expr("bigint(predicted_demand) * 115 div 100"),
            "forecast_error_pct": error_pct(),
            "model_version": version,
        },
    )
