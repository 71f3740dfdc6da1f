"""Metric views in the catalog: defined in one session, queried in another."""

import datetime as dt

import pytest

from shelfcast import INVENTORY_METRICS, METRIC_VIEWS, SHIPMENT_METRICS, Measure, metric_view, rows, total
from shelfcast.sources import metric_catalog
from shelfcast.sources.metric_catalog import definition, drop_metric_view, from_definition, list_metric_views, save_metric_view

from conftest import tuples


@pytest.fixture
def schema(spark, make_shipments, make_inventory):
    spark.sql("create schema room")
    make_shipments(
        ("O1", "2025-01-05", "S1", "Electronics", 4, "2.50", "W1", "East", "Delivered"),
        ("O1", "2025-01-05", "S2", "Electronics", 6, "1.00", "W1", "East", "Delivered"),
        ("O2", "2025-02-07", "S1", "Food", 5, "3.00", "W2", "West", "Cancelled"),
    ).write.saveAsTable("room.shipment_orders")
    make_inventory(("S1", "Food", "W1", "2025-01-01", 5, 10, 4, 2, "1.50")).write.saveAsTable("room.inventory_levels")
    yield "room"
    spark.sql("drop schema if exists room cascade")


def test_another_session_queries_another_grain(spark, schema):
    save_metric_view(spark, SHIPMENT_METRICS, "room.sales", "room.shipment_orders")
    other = spark.newSession()
    assert other is not spark
    view = metric_view(other, "room.sales")
    assert sorted(tuples(view.query(["fill_rate", "total_orders"], by=["order_month"]))) == [
        (dt.date(2025, 1, 1), 100.0, 1), (dt.date(2025, 2, 1), 0.0, 1),
    ]
    assert tuples(view.query(["fill_rate"])) == [(50.0,)]
    # the view can be selected from, derived dimensions too
    assert other.sql("select count(distinct order_month) from room.sales").first()[0] == 2


def test_own_measures_with_any_characters(spark, schema):
    odd = Measure("big_ones", "It's $big$ \\n \u00e9 \"q\"", {"n": rows("product_name <> '${x}' and quantity > 4"), "q": total("quantity")}, "{n} + 0 * {q}")
    view = SHIPMENT_METRICS.with_measures(odd)
    assert from_definition(definition(view, "t")) == (view, "t")
    save_metric_view(spark, view, "room.own", "room.shipment_orders")
    loaded = metric_view(spark.newSession(), "room.own")
    assert loaded.measures == view.measures and loaded.dimensions == view.dimensions
    assert tuples(loaded.query(["big_ones"])) == [(2,)]


def test_definitions_longer_than_a_property(spark, schema):
    many = [Measure(f"m{i}", "x" * 200, {"q": total("quantity")}, "{q}") for i in range(60)]
    save_metric_view(spark, SHIPMENT_METRICS.with_measures(*many), "room.long", "room.shipment_orders")
    assert all(len(v) <= metric_catalog.PART for k, v in metric_catalog.properties(spark, "room.long").items() if k.startswith(metric_catalog.PREFIX))
    assert tuples(metric_view(spark, "room.long").query(["m59"])) == [(15,)]


def test_replacing_and_dropping(spark, schema):
    save_metric_view(spark, SHIPMENT_METRICS, "room.v", "room.shipment_orders")
    save_metric_view(spark, INVENTORY_METRICS, "room.v", "room.inventory_levels")
    assert tuples(metric_view(spark, "room.v").query(["total_quantity_on_hand"])) == [(5,)]
    spark.sql("create view room.plain as select 1 as x")
    for taken in ("room.plain", "room.shipment_orders"):
        with pytest.raises(ValueError, match="not a metric view"):
            save_metric_view(spark, SHIPMENT_METRICS, taken, "room.shipment_orders")
        assert not drop_metric_view(spark, taken)
    assert list_metric_views(spark, "room") == ["v"]
    assert drop_metric_view(spark, "room.v") and not drop_metric_view(spark, "room.v")
    assert list_metric_views(spark, "room") == []


def test_what_cannot_be_queried_is_not_saved(spark, schema):
    wrong = SHIPMENT_METRICS.with_measures(Measure("w", "", {"q": total("no_such_column")}, "{q}"))
    with pytest.raises(Exception, match="no_such_column"):
        save_metric_view(spark, wrong, "room.w", "room.shipment_orders")
    assert not spark.catalog.tableExists("room.w")


def test_the_librarys_own_views_need_no_registration(spark, schema):
    view = metric_view(spark, "room.shipment_orders_metrics")
    assert view.measures == METRIC_VIEWS["shipment_orders_metrics"].measures
    assert tuples(view.query(["total_orders"])) == [(2,)]
