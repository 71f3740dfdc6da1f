import datetime as dt
from decimal import Decimal

import pytest

from conftest import tuples
from shelfcast.plans import analyses
from shelfcast.plans.benchmarks import BENCHMARKS, check_answers
from shelfcast.plans.catalogue import QUESTIONS, answer

LATEST = "2025-01-08"


@pytest.fixture(scope="module")
def inventory(make_inventory):
    return make_inventory(
        ("A", "x", "W1", "2025-01-01", 0, 20, 10, 4, "1.50"),  # old snapshot
        ("A", "x", "W1", LATEST, 18, 20, 10, 4, "1.50"),
        ("B", "x", "W1", LATEST, 9, 20, 10, 7, "2.00"),
        ("C", "y", "W2", LATEST, 20, 20, 10, 7, "3.00"),
        ("D", "y", "W2", LATEST, 21, 20, 10, 5, "0.25"),
        ("E", "z", "W2", LATEST, 0, 0, 0, 5, "9.99"),  # reorder point 0: ratio is NULL
    )


@pytest.fixture(scope="module")
def shipments(make_shipments):
    return make_shipments(
        ("O1", "2025-01-01", "A", "x", 10, "2.00", "W1", "N", "Delivered"),
        ("O2", "2025-01-05", "A", "x", 30, "2.00", "W1", "N", "Delivered"),  # 40 in 4 days
        ("O3", "2025-01-05", "A", "x", 99, "2.00", "W1", "N", "Cancelled"),
        ("O4", "2025-01-02", "B", "x", 50, "2.00", "W1", "S", "Delivered"),  # one day only
        ("O5", "2025-01-01", "D", "y", 1, "2.00", "W2", "S", "Delivered"),
        ("O5", "2025-01-03", "D", "y", 1, "2.00", "W2", "S", "Delivered"),  # 2 in 2 days
        ("O6", "2025-05-05", "D", "y", 7, "2.00", "W1", "S", "Backorder"),
    )


def test_below_reorder(inventory):
    assert [
        (r.product_sku, r.quantity_on_hand, r.stock_status)
        for r in analyses.below_reorder(inventory).collect()
    ] == [("E", 0, "LOW"), ("B", 9, "CRITICAL"), ("A", 18, "LOW"), ("C", 20, "LOW")]


def test_below_reorder_brief(inventory):
    got = analyses.below_reorder_brief(inventory)
    assert got.columns == [
        "product_sku", "product_name", "warehouse_id", "warehouse_name", "quantity_on_hand",
        "reorder_point",
    ]
    assert [r.product_sku for r in got.collect()] == ["E", "B", "A", "C"]


def test_reorder_by_lead_time(inventory):
    got = [(r.product_sku, r.lead_time_days) for r in analyses.reorder_by_lead_time(inventory).collect()]
    assert got == [("B", 7), ("C", 7), ("E", 5), ("A", 4)]


def test_inventory_value_counts_the_latest_snapshot_only(inventory):
    assert tuples(analyses.inventory_value_by_warehouse(inventory)) == [
        ("W2", "name W2", Decimal("65.25")),
        ("W1", "name W1", Decimal("45.00")),
    ]


def test_volumes(shipments):
    assert tuples(analyses.volume_by_warehouse(shipments)) == [("W1", 90), ("W2", 2)]
    # the window starts three months before 5 May, which is a backordered row
    assert tuples(analyses.recent_volume_by_warehouse(shipments)) == []
    # four months earlier is 5 January: one delivery that day
    assert tuples(analyses.recent_volume_by_warehouse(shipments, months=4)) == [("W1", 30, 1)]


def test_recent_volume_counts_orders_once(shipments):
    got = tuples(analyses.recent_volume_by_warehouse(shipments, months=12))
    assert got == [("W1", 90, 3), ("W2", 2, 1)]


def test_fill_rates(shipments):
    assert tuples(analyses.fill_rate_by_category(shipments)) == [("y", 50.0), ("x", 75.0)]
    assert tuples(analyses.low_fill_rate_warehouses(shipments)) == [("W1", 60.0)]
    assert tuples(analyses.low_fill_rate_warehouses(shipments, 60)) == []


def test_revenue(shipments):
    assert tuples(analyses.revenue_by_region(shipments)) == [
        ("S", Decimal("104.00")), ("N", Decimal("80.00")),
    ]


def test_daily_demand_of_one_day_is_null(shipments):
    demand = analyses.daily_demand(shipments)
    got = {(r.product_sku, r.warehouse_id): r.avg_daily_demand for r in demand.collect()}
    assert got == {("A", "W1"): 10.0, ("B", "W1"): None, ("D", "W2"): 1.0}


def test_days_of_supply(inventory, shipments):
    got = {r.product_sku: r.days_of_supply for r in analyses.days_of_supply(inventory, shipments).collect()}
    assert got == {"A": 1.8, "B": None, "C": None, "D": 21.0, "E": None}
    assert dict(tuples(analyses.days_of_supply_by_category(inventory, shipments))) == {
        "x": 1.8, "y": 21.0, "z": None,
    }


def test_stockout_risk(inventory, shipments):
    # B is below safety stock; A lasts 1.8 days against 4 days of lead time
    got = {(r.product_sku, r.days_of_supply) for r in analyses.stockout_risk(inventory, shipments).collect()}
    assert got == {("A", 1.8), ("B", None)}


def test_forecast_accuracy(make_forecasts):
    fc = make_forecasts(
        ("A", "x", "2025-01-01", 1, 1, 10.0, "v3.0", "N"),
        ("B", "x", "2025-01-01", 1, 1, 11.0, "v3.0", "N"),
        ("C", "x", "2025-01-01", 1, 0, None, "v3.0", "N"),
        ("D", "y", "2025-01-01", 1, 1, 2.5, "v3.0", "N"),
    )
    assert tuples(analyses.forecast_accuracy_by_category(fc)) == [("y", 97.5, 2.5, 1), ("x", 89.5, 10.5, 3)]
    assert tuples(analyses.forecast_accuracy_brief(fc)) == [("y", 97.5), ("x", 89.5)]


def test_actual_vs_forecast(make_forecasts):
    fc = make_forecasts(
        ("B", "Electronics", "2025-10-01", 90, 100, 10.0, "v3.2", "S"),
        ("B", "Electronics", "2025-10-01", 90, 80, 12.5, "v3.2", "N"),
        ("A", "Electronics", "2025-11-01", 5, 0, None, "v3.2", "N"),
        ("A", "Electronics", "2025-09-01", 5, 5, 0.0, "v3.2", "N"),
        ("A", "Toys", "2025-10-01", 5, 5, 0.0, "v3.2", "N"),
    )
    assert tuples(analyses.actual_vs_forecast(fc)) == [
        ("name B", dt.date(2025, 10, 1), 90, 80, -10, 87.5, "v3.2", "N"),
        ("name B", dt.date(2025, 10, 1), 90, 100, 10, 90.0, "v3.2", "S"),
        ("name A", dt.date(2025, 11, 1), 5, 0, -5, None, "v3.2", "N"),
    ]


def test_catalogue(inventory, shipments, make_forecasts):
    tables = {
        "shipment_orders": shipments,
        "inventory_levels": inventory,
        "demand_forecasts": make_forecasts(
            ("A", "Electronics", "2025-10-01", 5, 5, 0.0, "v3.2", "N")
        ),
    }
    for name in QUESTIONS:
        assert answer(name, tables).count() >= 0
    assert answer("low_fill_rate_warehouses", tables, below_pct=60).count() == 0
    with pytest.raises(KeyError, match="no question"):
        answer("nope", tables)


def test_check_answers(inventory, shipments):
    tables = {"shipment_orders": shipments, "inventory_levels": inventory}
    brief = analyses.below_reorder_brief(inventory)
    got = check_answers(
        {
            "below_reorder_brief": brief.where("product_sku <> 'E'"),
            "volume_by_warehouse": analyses.volume_by_warehouse(shipments),
        },
        tables,
    )
    assert tuples(got) == [("below_reorder_brief", 1, 0, False), ("volume_by_warehouse", 0, 0, True)]
    with pytest.raises(ValueError, match="not benchmarks"):
        check_answers({"nope": brief}, tables)
    assert set(BENCHMARKS) <= set(QUESTIONS)
