"""The questions as SQL functions give the rows of their analyses."""

import datetime as dt

import pytest

from shelfcast.operators.compare import compare
from shelfcast.plans.catalogue import answer
from shelfcast.plans.sql_functions import FUNCTIONS, register_functions
from shelfcast.sources import generate
from shelfcast.sources.sample import sample_products, sample_warehouses


@pytest.fixture(scope="module")
def room(spark):
    """A month of orders and two of stock and forecasts, as permanent tables of a schema."""
    spark.sql("create schema asked")
    start, end = dt.date(2025, 11, 1), dt.date(2025, 12, 31)
    products, warehouses = sample_products(spark), sample_warehouses(spark)
    tables = {
        "shipment_orders": generate.shipments(products, warehouses, start, end),
        "inventory_levels": generate.inventory(products, warehouses, start, end),
        "demand_forecasts": generate.forecasts(products, warehouses.select("region").distinct(), start, end),
    }
    for name, df in tables.items():
        df.coalesce(1).write.saveAsTable(f"asked.{name}")
    yield {name: f"asked.{name}" for name in tables}
    spark.sql("drop schema asked cascade")


def test_rows_of_the_analyses(spark, room):
    assert register_functions(spark, room) == list(FUNCTIONS)
    tables = {name: spark.table(place) for name, place in room.items()}
    for name in FUNCTIONS:
        got = compare(spark.sql(f"SELECT * FROM {name}()"), answer(name, tables))
        assert got.matches, (name, got)
    some = spark.sql("SELECT * FROM low_fill_rate_warehouses(below_pct => 92)")
    assert compare(some, answer("low_fill_rate_warehouses", tables, below_pct=92)).matches
    two = spark.sql("SELECT * FROM actual_vs_forecast('Food & Beverage', date'2025-12-01')")
    assert compare(two, answer("actual_vs_forecast", tables, category="Food & Beverage", from_date=dt.date(2025, 12, 1))).matches


def test_permanent_functions_are_seen_by_other_sessions(spark, room):
    assert register_functions(spark, room, schema="asked", only="volume_by_warehouse") == ["asked.volume_by_warehouse"]
    other = spark.newSession()
    want = answer("volume_by_warehouse", {n: other.table(p) for n, p in room.items()})
    other.sql("USE asked")
    assert compare(other.sql("SELECT * FROM volume_by_warehouse()"), want).matches


def test_without_a_table_its_functions_are_left_out(spark, room):
    made = register_functions(spark, {"demand_forecasts": room["demand_forecasts"]})
    assert made == ["forecast_accuracy_by_category", "actual_vs_forecast"]
