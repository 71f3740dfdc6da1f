import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import tuples
from shelfcast.operators.metrics import Measure, MetricView, distinct, mean, rows, total
from shelfcast.operators.views import (
    FORECAST_METRICS,
    INVENTORY_METRICS,
    METRIC_VIEWS,
    SHIPMENT_METRICS,
)

ALL = list(SHIPMENT_METRICS.measures)


@pytest.fixture(scope="module")
def shipments(make_shipments):
    return make_shipments(
        # O1 has a delivered and a backordered line; O4 and category y have no delivery
        ("O1", "2025-01-10", "A", "x", 10, "2.50", "W1", "N", "Delivered"),
        ("O1", "2025-01-10", "B", "x", 5, "1.00", "W1", "N", "Backorder"),
        ("O2", "2025-01-20", "A", "x", 7, "2.50", "W2", "S", "Delivered"),
        ("O3", "2025-02-01", "A", "x", 3, "2.50", "W1", "N", "Cancelled"),
        ("O4", "2025-02-02", "C", "y", 9, "1.10", "W1", "N", "In Transit"),
    )


def test_all_shipment_measures_by_category(shipments):
    got = {
        r.product_category: r.asDict()
        for r in SHIPMENT_METRICS.on(shipments).query(ALL, by=["product_category"]).collect()
    }
    assert got["x"] == {
        "product_category": "x",
        "total_units_shipped": 17,
        "total_revenue": Decimal("42.50"),
        "total_orders": 3,
        "delivered_orders": 2,
        "fill_rate": pytest.approx(200 / 3),
        "avg_order_size": 8.5,
    }
    assert got["y"] == {
        "product_category": "y",
        "total_units_shipped": None,
        "total_revenue": None,
        "total_orders": 1,
        "delivered_orders": 0,
        "fill_rate": 0.0,
        "avg_order_size": None,
    }


def test_ratios_are_formed_at_the_asked_grain(shipments):
    view = SHIPMENT_METRICS.on(shipments)
    assert view.query(["fill_rate", "avg_order_size"]).first() == (50.0, 8.5)
    by_warehouse = dict(tuples(view.query(["fill_rate"], by=["warehouse_id"])))
    assert by_warehouse == {"W1": pytest.approx(100 / 3), "W2": 100.0}


def test_order_with_mixed_lines_counts_once_in_each_status(shipments):
    got = dict(tuples(SHIPMENT_METRICS.on(shipments).query(["total_orders"], by=["order_status"])))
    assert got == {"Delivered": 2, "Backorder": 1, "Cancelled": 1, "In Transit": 1}


def test_computed_dimension(shipments):
    got = tuples(
        SHIPMENT_METRICS.on(shipments).query(
            ["total_orders"], by=["order_month"], order_by=["-order_month"]
        )
    )
    assert got == [(dt.date(2025, 2, 1), 2), (dt.date(2025, 1, 1), 2)]


def test_where_having_and_order(shipments):
    view = SHIPMENT_METRICS.on(shipments)
    got = tuples(
        view.query(
            ["total_orders"],
            by=["warehouse_id"],
            where="order_date < date'2025-02-01'",
            order_by=["-warehouse_id"],
        )
    )
    assert got == [("W2", 1), ("W1", 1)]
    assert tuples(
        view.query(["fill_rate"], by=["warehouse_id"], having="fill_rate < 95")
    ) == [("W1", pytest.approx(100 / 3))]


def test_no_rows_give_zero_counts_and_null_sums(shipments):
    got = SHIPMENT_METRICS.on(shipments.where("false")).query(ALL).first()
    assert tuple(got) == (None, None, 0, 0, None, None)
    assert SHIPMENT_METRICS.on(shipments.where("false")).query(ALL, by=["warehouse_id"]).count() == 0


def test_null_order_ids_are_not_counted(spark, shipments):
    with_null = shipments.withColumn("order_id", F.expr("nullif(order_id, 'O2')"))
    got = SHIPMENT_METRICS.on(with_null).query(ALL).first()
    assert (got.total_orders, got.delivered_orders, got.total_units_shipped) == (3, 1, 17)


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("by", [(), ("warehouse_id",), ("product_category", "order_status")])
def test_two_step_distinct_equals_plain_aggregation(make_shipments, seed, by):
    rng = random.Random(seed)
    statuses = ["Delivered", "Backorder", "In Transit", "Cancelled"]
    # a third of the rows belong to one order
    ship = make_shipments(
        *[
            (
                "hot" if rng.random() < 0.33 else f"O{rng.randrange(20)}",
                f"2025-0{rng.randrange(1, 10)}-15",
                f"S{rng.randrange(5)}",
                rng.choice("xyz"),
                rng.randrange(1, 50),
                f"{rng.randrange(100, 999) / 100}",
                f"W{rng.randrange(3)}",
                "R",
                rng.choice(statuses),
            )
            for _ in range(200)
        ]
    )
    got = SHIPMENT_METRICS.on(ship).query(ALL, by=by)
    delivered = F.col("order_status") == "Delivered"
    orders = F.count_distinct("order_id")
    delivered_orders = F.count_distinct(F.when(delivered, F.col("order_id")))
    units = F.sum(F.when(delivered, F.col("quantity")))
    want = ship.groupBy(*by).agg(
        units,
        F.sum(F.when(delivered, F.col("quantity") * F.col("unit_price"))),
        orders,
        delivered_orders,
        delivered_orders.cast("double") * 100 / orders,
        F.coalesce(units, F.lit(0)).cast("double") / F.nullif(delivered_orders, F.lit(0)),
    )
    assert sorted(tuples(got), key=str) == sorted(tuples(want), key=str)


def test_inventory_measures_and_as_of(make_inventory):
    inv = make_inventory(
        ("A", "x", "W1", "2025-01-01", 5, 20, 10, 4, "1.50"),
        ("A", "x", "W1", "2025-01-08", 10, 20, 10, 5, "1.50"),
        ("B", "x", "W1", "2025-01-08", 30, 20, 10, 8, "0.10"),
    )
    view = INVENTORY_METRICS.on(inv)
    names = list(INVENTORY_METRICS.measures)
    assert tuple(view.query(names).first()) == (45, Decimal("25.50"), 2, 1, pytest.approx(17 / 3))
    assert tuple(view.query(names, as_of="latest").first()) == (40, Decimal("18.00"), 1, 0, 6.5)
    assert tuple(INVENTORY_METRICS.on(inv.where("false")).query(names).first()) == (
        None, None, 0, 0, None,
    )


def test_forecast_measures_do_not_weight_errors(make_forecasts):
    fc = make_forecasts(
        ("A", "x", "2025-01-01", 90, 100, 10.0, "v3.0", "N"),
        ("B", "x", "2025-02-01", 1200, 1000, 20.0, "v3.0", "N"),
        ("C", "x", "2025-02-01", 5, 0, None, "v3.0", "N"),
    )
    got = FORECAST_METRICS.on(fc).query(list(FORECAST_METRICS.measures)).first()
    assert tuple(got) == (1295, 1100, 15.0, 85.0, -195, 3)


def test_own_measures_with_two_distinct_keys(shipments):
    view = SHIPMENT_METRICS.on(shipments).with_measures(
        Measure("products", "", {"p": distinct("product_sku")}, "{p}"),
        Measure("lines", "", {"n": rows()}, "{n}"),
        Measure("mean_quantity", "", {"q": mean("quantity")}, "{q}"),
        Measure("units", "", {"u": total("quantity")}, "{u}"),
    )
    assert view.query(["total_orders", "products", "lines", "mean_quantity", "units"]).first() == (
        4, 3, 5, 6.8, 34,
    )
    # one distinct key: the two-step form must give the same
    assert view.query(["products", "lines", "mean_quantity", "units"]).first() == (3, 5, 6.8, 34)


def test_source_needs_only_the_columns_used(shipments):
    narrow = shipments.select("order_id", "order_status", "warehouse_id")
    assert SHIPMENT_METRICS.on(narrow).query(["fill_rate"], by=["warehouse_id"]).count() == 2


def test_create_view(spark, shipments):
    SHIPMENT_METRICS.on(shipments).create_view("fills", ["fill_rate"], ["warehouse_id"])
    try:
        assert spark.sql("select fill_rate from fills where warehouse_id = 'W2'").first()[0] == 100.0
    finally:
        spark.catalog.dropTempView("fills")


def test_bad_requests_are_named(shipments):
    view = SHIPMENT_METRICS.on(shipments)
    with pytest.raises(ValueError, match="no measure"):
        view.query(["nope"])
    with pytest.raises(ValueError, match="no dimension"):
        view.query(["fill_rate"], by=["nope"])
    with pytest.raises(ValueError, match="as_of"):
        view.query(["fill_rate"], as_of="yesterday")
    with pytest.raises(ValueError, match="no source"):
        SHIPMENT_METRICS.query(["fill_rate"])


def test_definitions():
    assert sorted(METRIC_VIEWS) == [
        "demand_forecasts_metrics", "inventory_levels_metrics", "shipment_orders_metrics",
    ]
    assert [len(v.dimensions) for v in METRIC_VIEWS.values()] == [8, 6, 6]
    assert [len(v.measures) for v in METRIC_VIEWS.values()] == [6, 5, 6]
    assert all(m.comment for v in METRIC_VIEWS.values() for m in v.measures.values())
    assert isinstance(SHIPMENT_METRICS, MetricView)


def test_stock_at_the_end_of_each_period(make_inventory):
    rows = [
        ("S1", "Food", "W1", "2025-01-05", 50, 10, 4, 2, "1.00"),
        ("S1", "Food", "W1", "2025-01-26", 5, 10, 4, 2, "1.00"),
        ("S2", "Food", "W1", "2025-01-26", 7, 10, 4, 2, "2.00"),
        ("S1", "Food", "W1", "2025-02-02", 9, 10, 4, 4, "1.00"),
        ("S3", "Food", "W2", "2025-01-12", 1, 10, 4, 2, "1.00"),
    ]
    view = INVENTORY_METRICS.with_dimensions(month="trunc(snapshot_date, 'month')").on(make_inventory(*rows))
    got = view.query(["total_quantity_on_hand", "avg_lead_time"], by=["month", "warehouse_id"], as_of="period_end")
    assert sorted((str(r[0]), *r[1:]) for r in tuples(got)) == [
        ("2025-01-01", "W1", 12, 2.0), ("2025-01-01", "W2", 1, 2.0), ("2025-02-01", "W1", 9, 4.0),
    ]
    assert tuples(view.query(["total_inventory_value"], as_of="period_end"))[0][0] == 9
    assert view.query(["avg_lead_time"], by=["month"], where="warehouse_id = 'W9'", as_of="period_end").count() == 0


def test_a_filter_may_hold_the_name_of_a_dimension(make_shipments):
    df = make_shipments(
        ("O1", "2025-01-05", "S1", "order_month", 4, "2.50", "W1", "East", "Delivered"),
        ("O2", "2025-02-07", "S1", "Food", 5, "3.00", "W2", "West", "Delivered"),
    ).withColumn("order_month", F.lit("mine"))
    view = SHIPMENT_METRICS.on(df)
    assert tuples(view.query(["total_orders"], where="product_category = 'order_month'")) == [(1,)]
    assert tuples(view.query(["total_orders"], where="order_month = date'2025-02-01'")) == [(1,)]
    assert tuples(view.query(["total_orders"], where=F.col("order_month") == dt.date(2025, 2, 1))) == [(1,)]
    # a source without the dimension's columns is enough for what the query touches
    narrow = SHIPMENT_METRICS.on(df.select("order_id", "warehouse_id", "order_status"))
    assert tuples(narrow.query(["total_orders"], where="warehouse_id = 'W2'")) == [(1,)]
