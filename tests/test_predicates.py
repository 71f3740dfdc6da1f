import datetime as dt

from pyspark.sql import functions as F

from shelfcast.functions import (
    at_latest,
    below_reorder_point,
    below_safety_stock,
    is_delivered,
    is_weekday,
    trailing_months,
)


def test_weekday(spark):
    # 2025-03-01 is a Saturday
    days = spark.createDataFrame([(dt.date(2025, 3, d),) for d in range(1, 9)], "d date")
    kept = [r[0].day for r in days.where(is_weekday("d")).collect()]
    assert kept == [3, 4, 5, 6, 7]


def test_stock_predicates_at_the_bounds(spark):
    df = spark.createDataFrame(
        [(9,), (10,), (20,), (21,), (None,)], "quantity_on_hand int"
    ).withColumns({"reorder_point": F.lit(20), "safety_stock_qty": F.lit(10)})
    assert [r[0] for r in df.where(below_reorder_point()).collect()] == [9, 10, 20]
    assert [r[0] for r in df.where(below_safety_stock()).collect()] == [9]


def test_delivered_is_exact(spark):
    df = spark.createDataFrame([("Delivered",), ("delivered",), (None,)], "order_status string")
    assert df.where(is_delivered()).count() == 1


def test_latest_keeps_all_rows_of_the_last_date(make_inventory):
    inv = make_inventory(
        ("A", "c", "W", "2025-01-01", 1, 1, 1, 1, "1"),
        ("A", "c", "W", "2025-01-08", 2, 1, 1, 1, "1"),
        ("B", "c", "W", "2025-01-08", 3, 1, 1, 1, "1"),
    )
    assert sorted(r.quantity_on_hand for r in at_latest(inv).collect()) == [2, 3]


def test_latest_of_nothing_is_nothing(make_inventory):
    inv = make_inventory(("A", "c", "W", "2025-01-01", 1, 1, 1, 1, "1")).where("false")
    assert at_latest(inv).count() == 0


def test_trailing_window_clamps_to_month_end(make_shipments):
    ship = make_shipments(
        *[
            (f"O{i}", day, "A", "c", 1, "1", "W", "R", status)
            for i, (day, status) in enumerate(
                [
                    ("2025-09-29", "Delivered"),
                    ("2025-09-30", "Delivered"),
                    ("2025-12-01", "Delivered"),
                    ("2025-12-31", "Cancelled"),
                ]
            )
        ]
    )
    # the latest date belongs to a cancelled row and still anchors the window
    recent = trailing_months(ship, 3).where(is_delivered())
    assert sorted(str(r.order_date) for r in recent.collect()) == ["2025-09-30", "2025-12-01"]
