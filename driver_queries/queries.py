"""Every registered query: name to ``fn(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import replace
from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfcast.functions import at_latest, stock_status_3, stock_status_4
from shelfcast.operators import dictionary
from shelfcast.operators.compare import compared
from shelfcast.operators.dictionary import ENTITY_COLUMNS, FORMAT_COLUMNS
from shelfcast.operators.ordering import order_violations
from shelfcast.operators.rollup import Rollup, roll_up
from shelfcast.operators.snippets import snippet
from shelfcast.operators.top_values import top_values
from shelfcast.operators.views import FORECAST_METRICS, INVENTORY_METRICS, SHIPMENT_METRICS
from shelfcast.plans import analyses
from shelfcast.plans.benchmarks import check_answers
from shelfcast.plans.sql_functions import register_functions
from shelfcast.sources import adapters, generate
from shelfcast.sources.contracts import FORECASTS, INVENTORY, SHIPMENTS
from shelfcast.sources.sample import PROFILES, regions_of
from shelfcast.sources.spines import year_span
from shelfcast.sources.tables import parquet_table

Query = Callable[[SparkSession, str], DataFrame]

# On the test tables about half of the orders are delivered, so "low" starts at 50 percent.
LOW_FILL_PCT = 50
FORECAST_CATEGORY = "PROMO"
FORECAST_FROM = dt.date(2001, 5, 1)
MEAN_DIGITS = 6

# Which sample profile each part type follows; STANDARD has none and takes the default.
PROFILE_OF_TYPE = {
    "Electronics": "ECONOMY",
    "Clothing & Apparel": "SMALL",
    "Food & Beverage": "MEDIUM",
    "Health & Wellness": "LARGE",
    "Home & Garden": "PROMO",
    None: None,
}


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Means of doubles depend on the order of addition in the last digits; cut those off."""
    return df.withColumns({c: F.round(c, MEAN_DIGITS) for c in columns})


# --- shipments ---


def fill_rate_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyses.fill_rate_by_category(
        adapters.shipments(spark, sf_dir, ["order_id", "product_category", "order_status"])
    )


def fill_rate_in_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter on a dimension that the query does not group by."""
    needed = ["order_id", "order_date", "product_category", "order_status"]
    return SHIPMENT_METRICS.on(adapters.shipments(spark, sf_dir, needed)).query(
        ["fill_rate", "total_orders"], by=["product_category"],
        where="order_month between date'1995-03-01' and date'1996-02-01'",
    )


def revenue_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyses.revenue_by_region(
        adapters.shipments(
            spark, sf_dir, ["quantity", "unit_price", "destination_region", "order_status"]
        )
    )


ALL_SHIPMENT_MEASURES = list(SHIPMENT_METRICS.measures)
MEASURED = ["order_id", "order_date", "quantity", "unit_price", "order_status"]


def _shipment_metrics(spark: SparkSession, sf_dir: str, *by: str) -> DataFrame:
    columns = list(dict.fromkeys(MEASURED + [d for d in by if d != "order_month"]))
    view = SHIPMENT_METRICS.on(adapters.shipments(spark, sf_dir, columns))
    return view.query(ALL_SHIPMENT_MEASURES, by=by, order_by=by)


def shipment_metrics_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shipment_metrics(spark, sf_dir, "order_month")


def shipment_metrics_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shipment_metrics(spark, sf_dir)


def shipment_metrics_by_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shipment_metrics(spark, sf_dir, "product_sku", "product_name")


def shipment_metrics_by_day_and_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shipment_metrics(spark, sf_dir, "order_date", "order_status")


def _shipment_rollup(spark: SparkSession, sf_dir: str) -> Rollup:
    """By day, category and status; order ids are their numbers behind a prefix."""
    shipments = adapters.shipments(spark, sf_dir, [*MEASURED, "product_category"])
    return roll_up(
        SHIPMENT_METRICS.on(shipments),
        ["order_date", "product_category", "order_status"],
        key_number="cast(substr(order_id, 5) as bigint)",
    )


def rollup_fill_rate_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct orders by category from a finer rollup, never from the rows."""
    rollup = _shipment_rollup(spark, sf_dir)
    return rollup.query(["fill_rate"], by=["product_category"], order_by=["fill_rate"])


def rollup_metrics_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All measures by a dimension that is derived from one of the rollup's."""
    return _shipment_rollup(spark, sf_dir).query(
        ALL_SHIPMENT_MEASURES, by=["order_month"], order_by=["order_month"]
    )


def gross_volume_by_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    shipments = adapters.shipments(spark, sf_dir, ["order_date", "quantity", "unit_price"])
    return (
        shipments.groupBy(snippet("quarterly").column())
        .agg(snippet("shipment volume").column(), snippet("sales").column())
        .orderBy("order_quarter")
    )


def delivered_volume_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    shipments = adapters.shipments(
        spark, sf_dir, ["order_date", "quantity", "unit_price", "order_status"]
    )
    return (
        shipments.where(snippet("completed orders").build())
        .groupBy(snippet("month").column())
        .agg(snippet("units shipped").column(), snippet("revenue").column())
        .orderBy("order_month")
    )


def low_fill_rate_warehouses(spark: SparkSession, sf_dir: str) -> DataFrame:
    shipments = adapters.shipments(spark, sf_dir, ["order_id", "warehouse_id", "order_status"])
    return analyses.low_fill_rate_warehouses(shipments, LOW_FILL_PCT)


def volume_by_warehouse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyses.volume_by_warehouse(
        adapters.shipments(spark, sf_dir, ["quantity", "warehouse_id", "order_status"])
    )


def volume_last_3_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyses.recent_volume_by_warehouse(
        adapters.shipments(
            spark, sf_dir, ["order_id", "order_date", "quantity", "warehouse_id", "order_status"]
        )
    )


# --- inventory ---

ALL_INVENTORY_MEASURES = list(INVENTORY_METRICS.measures)


def inventory_metrics_by_warehouse(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ["warehouse_id", "warehouse_name"]
    return INVENTORY_METRICS.on(adapters.inventory(spark, sf_dir)).query(
        ALL_INVENTORY_MEASURES, by=by, order_by=by
    )


def inventory_metrics_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return INVENTORY_METRICS.on(adapters.inventory(spark, sf_dir)).query(
        ALL_INVENTORY_MEASURES,
        by=["product_category"],
        order_by=["-total_inventory_value"],
        as_of="latest",
    )


def inventory_metrics_by_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ["snapshot_date", "product_category"]
    return INVENTORY_METRICS.on(adapters.inventory(spark, sf_dir)).query(
        ALL_INVENTORY_MEASURES, by=by, order_by=by
    )


def inventory_value_by_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = at_latest(adapters.inventory(spark, sf_dir))
    return (
        latest.groupBy("product_sku", "product_name")
        .agg(snippet("stock value").column())
        .orderBy(F.desc("total_inventory_value"), "product_sku")
    )


def below_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyses.below_reorder(adapters.inventory(spark, sf_dir))


def below_reorder_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyses.below_reorder_brief(adapters.inventory(spark, sf_dir))


def reorder_by_lead_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyses.reorder_by_lead_time(adapters.inventory(spark, sf_dir))


def stock_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, critical = snippet("low stock").build(), snippet("critical stock").build()
    return (
        adapters.inventory(spark, sf_dir)
        .groupBy(
            "snapshot_date",
            stock_status_3().alias("status_3"),
            stock_status_4().alias("status_4"),
        )
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.count_if(low).alias("low_rows"),
            F.count_if(critical).alias("critical_rows"),
        )
        .orderBy("snapshot_date", "status_4")
    )


def inventory_value_by_warehouse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyses.inventory_value_by_warehouse(adapters.inventory(spark, sf_dir))


# --- inventory and shipments ---

DEMAND_COLUMNS = ["product_sku", "warehouse_id", "order_date", "quantity", "order_status"]


def days_of_supply_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyses.days_of_supply_by_category(
        adapters.inventory(spark, sf_dir), adapters.shipments(spark, sf_dir, DEMAND_COLUMNS)
    )


def stockout_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyses.stockout_risk(
        adapters.inventory(spark, sf_dir), adapters.shipments(spark, sf_dir, DEMAND_COLUMNS)
    )


# --- forecasts ---


def forecast_accuracy_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyses.forecast_accuracy_by_category(adapters.forecasts(spark, sf_dir))


def forecast_accuracy_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyses.forecast_accuracy_brief(adapters.forecasts(spark, sf_dir))


def _forecast_metrics(spark: SparkSession, sf_dir: str, *by: str) -> DataFrame:
    result = FORECAST_METRICS.on(adapters.forecasts(spark, sf_dir)).query(
        list(FORECAST_METRICS.measures), by=by, order_by=by
    )
    return _rounded(result, "avg_forecast_error", "avg_forecast_accuracy")


def forecast_metrics_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forecast_metrics(spark, sf_dir, "model_version")


def forecast_metrics_by_region_and_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forecast_metrics(spark, sf_dir, "region", "forecast_date")


def forecast_accuracy_by_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        adapters.forecasts(spark, sf_dir)
        .groupBy("product_sku")
        .agg(snippet("model accuracy").column())
        .orderBy("product_sku")
    )


def actual_vs_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyses.actual_vs_forecast(
        adapters.forecasts(spark, sf_dir), FORECAST_CATEGORY, FORECAST_FROM
    )


def forecast_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.forecasts(spark, sf_dir)


# --- generators over all parts, and one distribution centre per region with suppliers ---


def gen_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet_table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("product_sku"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("product_category"),
        F.col("p_retailprice").cast("decimal(10,2)").alias("unit_price"),
        F.col("p_retailprice").cast("decimal(10,2)").alias("unit_cost"),
        (20 + 4 * F.col("p_size")).alias("reorder_point"),
        (10 + 2 * F.col("p_size")).alias("safety_stock_qty"),
    )


def gen_warehouses(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = parquet_table(spark, sf_dir, "supplier")
    nation = parquet_table(spark, sf_dir, "nation")
    region = parquet_table(spark, sf_dir, "region")
    return (
        supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
        .groupBy("r_regionkey", "r_name")
        .agg(F.count(F.lit(1)).alias("suppliers"))
        .select(
            F.concat(F.lit("DC-"), F.col("r_regionkey").cast("string")).alias("warehouse_id"),
            F.concat("r_name", F.lit(" DC")).alias("warehouse_name"),
            F.col("r_name").alias("region"),
            (4 + F.col("suppliers") % 4).cast("int").alias("lead_time_days"),
        )
    )


def gen_profiles():
    return [replace(p, category=PROFILE_OF_TYPE[p.category]) for p in PROFILES]


def gen_shipments(spark: SparkSession, sf_dir: str, years: int = 1) -> DataFrame:
    start, end = year_span(years)
    return generate.shipments(
        gen_products(spark, sf_dir),
        gen_warehouses(spark, sf_dir),
        start,
        end,
        profiles=gen_profiles(),
    )


def gen_inventory(spark: SparkSession, sf_dir: str, years: int = 1) -> DataFrame:
    start, end = year_span(years)
    return generate.inventory(
        gen_products(spark, sf_dir),
        gen_warehouses(spark, sf_dir),
        start,
        end,
        profiles=gen_profiles(),
    )


def gen_forecasts(spark: SparkSession, sf_dir: str, years: int = 1) -> DataFrame:
    start, end = year_span(years)
    return generate.forecasts(
        gen_products(spark, sf_dir),
        regions_of(gen_warehouses(spark, sf_dir)),
        start,
        end,
        profiles=gen_profiles(),
    )


def gen_shipments_two_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order numbers run on from the first year into the second."""
    return gen_shipments(spark, sf_dir, years=2)


def gen_inventory_two_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot days follow from the first day, so the last year's differ from those of one year."""
    return gen_inventory(spark, sf_dir, years=2)


def gen_forecasts_two_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gen_forecasts(spark, sf_dir, years=2)


def warehouse_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions_of(gen_warehouses(spark, sf_dir))


# --- profiling and checking ---


#: The order that answers come in, by query.
ANSWER_ORDERS = {
    below_reorder: ["stock_ratio", "product_sku", "warehouse_id"],
    below_reorder_brief: ["quantity_on_hand", "product_sku", "warehouse_id"],
    reorder_by_lead_time: ["-lead_time_days", "quantity_on_hand", "product_sku", "warehouse_name"],
    revenue_by_region: ["-total_revenue"],
    fill_rate_by_category: ["fill_rate"],
    actual_vs_forecast: ["forecast_date", "product_name", "region"],
}


def answer_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each sorted answer, and how many of them stand before their predecessor."""

    def counted(query: Query, order: list[str]) -> DataFrame:
        rows = query(spark, sf_dir)
        if "stock_ratio" in order:
            rows = rows.withColumn("stock_ratio", F.col("quantity_on_hand") / F.col("reorder_point"))
        return order_violations(rows, order).select(
            F.lit(query.__name__).alias("question"), "n_rows", "out_of_order"
        )

    return reduce(DataFrame.unionByName, [counted(q, order) for q, order in ANSWER_ORDERS.items()])


def value_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ENTITY_COLUMNS[SHIPMENTS.table]
    return dictionary.value_dictionary(adapters.shipments(spark, sf_dir, columns), columns)


def value_dictionary_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.value_dictionary(
        adapters.inventory(spark, sf_dir), ENTITY_COLUMNS[INVENTORY.table]
    )


def value_dictionary_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.value_dictionary(
        adapters.forecasts(spark, sf_dir), ENTITY_COLUMNS[FORECASTS.table]
    )


def top_values_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent values of the identifier columns."""
    columns = ["order_id", "customer_id", "product_sku", "warehouse_id"]
    return top_values(adapters.shipments(spark, sf_dir, columns), columns, 10)


def format_profile_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = FORMAT_COLUMNS[SHIPMENTS.table]
    return dictionary.format_profile(adapters.shipments(spark, sf_dir, columns), columns)


def format_profile_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = FORMAT_COLUMNS[INVENTORY.table]
    return dictionary.format_profile(adapters.inventory(spark, sf_dir), columns)


def format_profile_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = FORMAT_COLUMNS[FORECASTS.table]
    return dictionary.format_profile(adapters.forecasts(spark, sf_dir), columns)


def answer_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark questions on shipments, answered in another way: all answers match."""
    needed = {
        "volume_by_warehouse": ["quantity", "warehouse_id", "order_status"],
        "fill_rate_by_category": ["order_id", "product_category", "order_status"],
        "revenue_by_region": ["quantity", "unit_price", "destination_region", "order_status"],
    }

    def rows(question: str, delivered: bool) -> DataFrame:
        shipments = adapters.shipments(spark, sf_dir, needed[question])
        return shipments.where(snippet("delivered orders").build()) if delivered else shipments

    orders = F.count_distinct("order_id")
    filled = F.count_distinct(F.when(F.col("order_status") == "Delivered", F.col("order_id")))
    answers = {
        "volume_by_warehouse": SHIPMENT_METRICS.on(rows("volume_by_warehouse", True))
        .query(["total_units_shipped"], by=["warehouse_id"])
        .withColumnRenamed("total_units_shipped", "total_shipped"),
        "fill_rate_by_category": rows("fill_rate_by_category", False).groupBy("product_category").agg(
            (filled.cast("double") * 100 / orders).alias("fill_rate")
        ),
        "revenue_by_region": rows("revenue_by_region", True).groupBy("destination_region")
        .agg(snippet("sales").column())
        .withColumnRenamed("gross_revenue", "total_revenue"),
    }
    return check_answers(answers, lambda question: {SHIPMENTS.table: rows(question, False)})


def answer_check_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark questions on inventory, answered in another way: all answers match."""
    inventory = adapters.inventory(spark, sf_dir)
    low = at_latest(inventory).where(snippet("needs reorder").build())
    answers = {
        "below_reorder_brief": analyses.below_reorder(inventory).drop(
            "safety_stock_qty", "stock_status"
        ),
        "inventory_value_by_warehouse": INVENTORY_METRICS.on(inventory)
        .query(["total_inventory_value"], by=["warehouse_id", "warehouse_name"], as_of="latest")
        .withColumnRenamed("total_inventory_value", "total_value"),
        "reorder_by_lead_time": low.select(
            "product_sku", "product_name", "warehouse_name", "quantity_on_hand",
            "reorder_point", "lead_time_days",
        ),
    }
    return check_answers(answers, {INVENTORY.table: inventory})


def answer_check_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark question on forecasts, answered by a snippet: the answer matches."""
    forecasts = adapters.forecasts(spark, sf_dir)
    by_snippet = (
        forecasts.groupBy("product_category")
        .agg(snippet("forecast accuracy").column())
        .withColumnRenamed("avg_forecast_accuracy", "accuracy_pct")
    )
    return check_answers(
        {"forecast_accuracy_brief": by_snippet}, {FORECASTS.table: forecasts}
    )


def answer_check_wrong(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three benchmark questions answered with a usual mistake: the differences are counted.

    Orders of every status, snapshots of every date, and orders counted by line.
    """
    needed = {
        "volume_by_warehouse": ["quantity", "warehouse_id", "order_status"],
        "fill_rate_by_category": ["order_id", "product_category", "order_status"],
    }
    volumes, fills = (adapters.shipments(spark, sf_dir, c) for c in needed.values())
    inventory = adapters.inventory(spark, sf_dir)
    low = inventory.where(snippet("low stock").build())
    lines = F.count("order_id")
    filled = F.count(F.when(F.col("order_status") == "Delivered", F.col("order_id")))
    answers = {
        "volume_by_warehouse": volumes.groupBy("warehouse_id").agg(
            F.sum("quantity").alias("total_shipped")
        ),
        "below_reorder_brief": low.select(
            "product_sku", "product_name", "warehouse_id", "warehouse_name",
            "quantity_on_hand", "reorder_point",
        ),
        "fill_rate_by_category": fills.groupBy("product_category").agg(
            (filled.cast("double") * 100 / lines).alias("fill_rate")
        ),
    }
    tables = {"volume_by_warehouse": volumes, "fill_rate_by_category": fills}
    return check_answers(
        answers, lambda question: {SHIPMENTS.table: tables.get(question), INVENTORY.table: inventory}
    )


def answer_check_near_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that are nearly right: halves in a column of whole numbers, every row twice, a value
    as text."""
    volumes = adapters.shipments(spark, sf_dir, ["quantity", "warehouse_id", "order_status"])
    fills = adapters.shipments(spark, sf_dir, ["product_category", "order_id", "order_status"])
    volume = analyses.volume_by_warehouse(volumes)
    rates = analyses.fill_rate_by_category(fills)
    inventory = adapters.inventory(spark, sf_dir)
    value = analyses.inventory_value_by_warehouse(inventory)
    return check_answers(
        {
            "volume_by_warehouse": volume.withColumn("total_shipped", F.col("total_shipped") + F.lit(0.5).cast("double")),
            "fill_rate_by_category": rates.unionAll(rates),
            "inventory_value_by_warehouse": value.withColumn("total_value", F.col("total_value").cast("string")),
        },
        lambda question: {
            SHIPMENTS.table: fills if question == "fill_rate_by_category" else volumes,
            INVENTORY.table: inventory,
        },
    )


def answer_check_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that differ in a digit no double has: whole numbers above 2^53 as doubles, amounts
    of 19 digits that are two cents off; and amounts with more places, which match."""
    lines = parquet_table(spark, sf_dir, "lineitem")
    sums = lines.groupBy("l_suppkey").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("units"))
    whole = sums.select("l_suppkey", (F.col("units") + 2**53).alias("value"))
    amount = (F.col("units") + F.lit(Decimal("90071992547409920.01"))).cast("decimal(22,2)")
    amounts = sums.select("l_suppkey", amount.alias("value"))
    return compared(
        {
            "whole_as_double": (whole.withColumn("value", F.col("value").cast("double")), whole),
            "two_cents_off": (amounts.withColumn("value", (F.col("value") + F.lit(Decimal("0.02"))).cast("decimal(24,4)")), amounts),
            "more_places": (amounts.withColumn("value", F.col("value").cast("decimal(24,4)")), amounts),
        }
    ).withColumnRenamed("name", "question")


def _sql_functions(spark: SparkSession, sf_dir: str) -> None:
    views = {
        SHIPMENTS.table: adapters.shipments(spark, sf_dir),
        INVENTORY.table: adapters.inventory(spark, sf_dir),
        FORECASTS.table: adapters.forecasts(spark, sf_dir),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(f"test_{name}")
    register_functions(spark, {name: f"test_{name}" for name in views})


def sql_low_fill_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warehouses below a fill rate, by the SQL function."""
    _sql_functions(spark, sf_dir)
    return spark.sql(f"SELECT * FROM low_fill_rate_warehouses({LOW_FILL_PCT})")


def sql_recent_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivered units and orders of the last three months, by the SQL function's default."""
    _sql_functions(spark, sf_dir)
    return spark.sql("SELECT * FROM recent_volume_by_warehouse()")


def sql_actual_vs_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast against actual of a category, by the SQL function with named arguments."""
    _sql_functions(spark, sf_dir)
    return spark.sql(
        f"SELECT * FROM actual_vs_forecast(from_date => date'{FORECAST_FROM}', category => '{FORECAST_CATEGORY}')"
    )


def sql_stockout_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock that may run out, by the SQL function."""
    _sql_functions(spark, sf_dir)
    return spark.sql("SELECT * FROM stockout_risk()")


def inventory_month_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock of each warehouse at its last snapshot of each month."""
    view = INVENTORY_METRICS.with_dimensions(snapshot_month="trunc(snapshot_date, 'month')")
    return view.on(adapters.inventory(spark, sf_dir)).query(
        list(INVENTORY_METRICS.measures), by=["snapshot_month", "warehouse_id"], as_of="period_end"
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        fill_rate_by_category,
        fill_rate_in_months,
        revenue_by_region,
        format_profile_inventory,
        format_profile_forecasts,
        answer_check_near_miss,
        shipment_metrics_by_month,
        shipment_metrics_global,
        shipment_metrics_by_product,
        shipment_metrics_by_day_and_status,
        rollup_fill_rate_by_category,
        rollup_metrics_by_month,
        gross_volume_by_quarter,
        delivered_volume_by_month,
        low_fill_rate_warehouses,
        volume_by_warehouse,
        volume_last_3_months,
        inventory_metrics_by_warehouse,
        inventory_metrics_latest,
        inventory_metrics_by_snapshot,
        inventory_value_by_product,
        below_reorder,
        below_reorder_brief,
        reorder_by_lead_time,
        stock_status_counts,
        inventory_value_by_warehouse,
        days_of_supply_by_category,
        stockout_risk,
        forecast_accuracy_by_category,
        forecast_accuracy_brief,
        forecast_metrics_by_model,
        forecast_metrics_by_region_and_month,
        forecast_accuracy_by_product,
        actual_vs_forecast,
        forecast_table,
        gen_shipments,
        gen_inventory,
        gen_forecasts,
        gen_shipments_two_years,
        gen_inventory_two_years,
        gen_forecasts_two_years,
        answer_order,
        warehouse_regions,
        value_dictionary,
        value_dictionary_inventory,
        value_dictionary_forecasts,
        top_values_shipments,
        format_profile_shipments,
        answer_check,
        answer_check_inventory,
        answer_check_forecasts,
        answer_check_wrong,
        answer_check_exact,
        inventory_month_end,
        sql_low_fill_rate,
        sql_recent_volume,
        sql_actual_vs_forecast,
        sql_stockout_risk,
    )
}
