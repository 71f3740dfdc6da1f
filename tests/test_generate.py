import datetime as dt

import pytest
from pyspark.sql import Window, functions as F

from conftest import tuples
from shelfcast.functions import is_weekday
from shelfcast.operators.compare import compare
from shelfcast.sources import generate
from shelfcast.sources.contracts import CONTRACTS
from shelfcast.sources.sample import regions_of, sample_products, sample_warehouses
from shelfcast.sources.spines import with_dates, with_weekdays, year_span

S, I, FC = "shipment_orders", "inventory_levels", "demand_forecasts"


@pytest.fixture(scope="module")
def tables(spark):
    made = {name: df.cache() for name, df in generate.sample_tables(spark).items()}
    yield made
    for df in made.values():
        df.unpersist()


def test_row_counts_of_one_year(tables):
    assert {name: df.count() for name, df in tables.items()} == {S: 1390, I: 4081, FC: 924}
    assert dict(tuples(tables[S].groupBy("order_status").count())) == {
        "Delivered": 1314, "Backorder": 43, "Cancelled": 28, "In Transit": 5,
    }


def test_row_counts_of_five_years(spark):
    five = generate.sample_tables(spark, scale=5)
    assert {name: df.count() for name, df in five.items()} == {S: 6831, I: 20097, FC: 4620}
    assert five[I].agg(F.max("snapshot_date")).first()[0] == dt.date(2025, 12, 26)


def test_schemas_follow_the_contracts(tables):
    for name, df in tables.items():
        assert dict(df.dtypes) == {f.name: f.type for f in CONTRACTS[name].fields}


@pytest.mark.parametrize("seed", [generate.SEED, 99])
def test_properties(spark, seed):
    made = generate.sample_tables(spark, seed)
    lag = F.datediff("delivery_date", "order_date")
    orders = made[S].agg(
        F.count_if(~F.dayofweek("order_date").between(2, 6)),
        F.min(lag),
        F.max(lag),
        F.count_if((F.col("order_status") == "In Transit") & (F.col("order_date") <= "2025-11-15")),
        F.count_distinct("order_id") - F.count("order_id"),
    ).first()
    assert tuple(orders) == (0, 2, 5, 0, 0)
    stock = made[I].agg(F.min("quantity_on_hand"), F.max(F.col("lead_time_days"))).first()
    assert stock[0] >= 0 and stock[1] <= 8
    bounds = made[FC].agg(
        F.count_if(F.col("actual_demand") < F.col("confidence_lower")),
        F.count_if(F.col("actual_demand") > F.col("confidence_upper")),
        F.max("forecast_error_pct"),
        F.count_if(F.dayofmonth("forecast_date") != 1),
    ).first()
    assert tuple(bounds[:2]) == (0, 0) and bounds[2] < 15 and bounds[3] == 0
    versions = made[FC].groupBy("model_version").agg(
        F.min(F.month("forecast_date")), F.max(F.month("forecast_date"))
    )
    assert sorted(tuples(versions)) == [("v3.0", 1, 4), ("v3.1", 5, 8), ("v3.2", 9, 12)]


def test_same_seed_same_rows_other_seed_other_rows(spark, tables):
    again, other = generate.sample_tables(spark), generate.sample_tables(spark, 99)
    for name in tables:
        assert compare(again[name], tables[name]).matches
        assert not compare(other[name], tables[name]).matches


def test_order_ids_rank_date_sku_warehouse(tables):
    order = Window.orderBy("order_date", "product_sku", "warehouse_id")
    number = F.substring("order_id", 5, 20).cast("int") - 10000
    wrong = tables[S].where("true").withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") != number
    )
    assert wrong.count() == 0


def test_layout_does_not_change_the_rows(spark, tables):
    products, warehouses = sample_products(spark), sample_warehouses(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        start, end = year_span()
        for buckets in (1, 7, 64):
            cut = generate.shipments(products, warehouses, start, end, rank_buckets=buckets)
            assert compare(cut, tables[S]).matches
        assert compare(generate.inventory(products, warehouses, start, end), tables[I]).matches
        regions = regions_of(warehouses)
        assert compare(generate.forecasts(products, regions, start, end), tables[FC]).matches
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_own_dimensions_and_categories(spark):
    products = spark.createDataFrame(
        [("P1", "one", "Unheard of", 2, 1, 100, 50)],
        "product_sku string, product_name string, product_category string, "
        "unit_price int, unit_cost int, reorder_point int, safety_stock_qty int",
    )
    start, end = year_span(3)
    made = generate.shipments(products, sample_warehouses(spark), start, end, customers=3)
    quantity = made.agg(F.min("quantity"), F.max("quantity"), F.count_distinct("customer_id")).first()
    assert quantity[0] >= 10 and quantity[1] < 110 and quantity[2] <= 3


@pytest.mark.parametrize("first, days", [("2025-01-01", 365), ("2025-01-04", 2), ("2025-01-04", 3), ("2025-01-08", 1)])
def test_weekdays_are_the_days_but_weekends(spark, first, days):
    start = dt.date.fromisoformat(first)
    end = start + dt.timedelta(days=days - 1)
    got = with_weekdays(spark.range(2), "day", start, end)
    want = with_dates(spark.range(2), "day", start, end, "day").where(is_weekday("day"))
    assert got.dtypes == want.dtypes
    assert sorted(tuples(got)) == sorted(tuples(want))


def test_orders_are_never_unfolded_over_weekends(spark):
    """The days that no order can have are left out before the unfolding, not filtered behind it."""
    start, end = year_span(1)
    orders = generate.shipments(sample_products(spark), sample_warehouses(spark), start, end)
    assert "dayofweek" not in orders._jdf.queryExecution().optimizedPlan().toString()
