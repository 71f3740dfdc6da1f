import pytest
from pyspark.sql import functions as F

from conftest import tuples
from shelfcast.operators.metrics import Measure, distinct, total
from shelfcast.operators.rollup import buckets_of, number_keys, roll_up
from shelfcast.operators.views import SHIPMENT_METRICS

NUMBER = "cast(substr(order_id, 2) as bigint)"
ROWS = [
    ("O1", "2025-01-01", "S1", "A", 10, "1.50", "W1", "East", "Delivered"),
    ("O1", "2025-01-01", "S2", "B", 20, "2.00", "W1", "East", "Delivered"),
    ("O1", "2025-01-02", "S1", "A", 5, "1.50", "W2", "East", "Cancelled"),
    ("O2", "2025-01-02", "S1", "A", 7, "1.50", "W1", "West", "Backorder"),
    ("O40000", "2025-02-03", "S2", "B", 9, "2.00", "W2", "West", "Delivered"),
    ("O40000", "2025-02-04", "S1", "A", 1, "1.50", "W2", "West", "In Transit"),
    (None, "2025-02-04", "S1", "A", 2, "1.50", "W2", "West", "Delivered"),
    ("O3", "2025-02-04", "S3", None, 2, "3.50", "W2", "West", "Delivered"),
]
FINE = ["order_date", "product_category", "order_status"]
ALL = list(SHIPMENT_METRICS.measures)


@pytest.fixture(scope="module")
def view(make_shipments):
    return SHIPMENT_METRICS.on(make_shipments(*ROWS))


def same(a, b):
    assert a.dtypes == b.dtypes
    assert sorted(tuples(a), key=repr) == sorted(tuples(b), key=repr)


@pytest.mark.parametrize("by", [[], ["product_category"], ["order_month"], ["order_status", "order_date"]])
def test_any_coarser_grain_equals_the_direct_query(view, by):
    same(roll_up(view, FINE, key_number=NUMBER).query(ALL, by=by), view.query(ALL, by=by))


def test_filters_and_order(view):
    rolled = roll_up(view, FINE, ["fill_rate", "total_orders"], NUMBER)
    asked = dict(by=["product_category"], where="order_month = date'2025-01-01'", having="total_orders > 0")
    same(rolled.query(["fill_rate"] + ["total_orders"], **asked), view.query(["fill_rate", "total_orders"], **asked))
    ordered = rolled.query(["total_orders"], by=["product_category"], order_by=["-total_orders"])
    assert [r[1] for r in ordered.collect()] == [3, 2, 1]


def test_stored_appended_and_compacted(view, make_shipments, tmp_path):
    path = str(tmp_path / "rollup")
    for half in (ROWS[:4], ROWS[4:], []):
        rolled = roll_up(SHIPMENT_METRICS.on(make_shipments(*half) if half else view.source.limit(0)), FINE, key_number=NUMBER)
        rolled.table.write.mode("append").parquet(path)
    stored = rolled.on(view.source.sparkSession.read.parquet(path))
    same(stored.query(ALL, by=["product_category"]), view.query(ALL, by=["product_category"]))
    again = stored.compacted()
    assert again.table.dtypes == stored.table.dtypes
    same(again.compacted().query(ALL), view.query(ALL))


def test_the_same_rows_twice_count_orders_once(view):
    rolled = roll_up(view, FINE, ["total_orders"], NUMBER)
    twice = rolled.on(rolled.table.unionAll(rolled.table))
    same(twice.query(["total_orders"]), view.query(["total_orders"]))


def test_empty(view):
    nothing = SHIPMENT_METRICS.on(view.source.limit(0))
    same(roll_up(nothing, FINE, key_number=NUMBER).query(ALL), nothing.query(ALL))
    assert roll_up(nothing, FINE, key_number=NUMBER).query(ALL, by=["order_month"]).count() == 0


def test_what_a_rollup_does_not_hold(view):
    rolled = roll_up(view, FINE, ["total_orders"], NUMBER)
    for ask in (lambda: rolled.query(["total_revenue"]), lambda: rolled.query(["total_orders"], by=["warehouse_id"]),
                lambda: rolled.query(["nothing"]), lambda: roll_up(view, FINE), lambda: roll_up(SHIPMENT_METRICS, FINE)):
        with pytest.raises(ValueError):
            ask()
    two = view.with_measures(Measure("places", "", {"a": distinct("warehouse_id"), "b": distinct("order_id")}, "{a} + {b}"))
    with pytest.raises(ValueError, match="one key"):
        roll_up(two, FINE, ["places"], NUMBER)
    plain = view.with_measures(Measure("units", "", {"u": total("quantity")}, "{u}"))
    same(roll_up(plain, FINE, ["units"]).query(["units"], by=["product_category"]), plain.query(["units"], by=["product_category"]))


def test_numbered_text_keys(view):
    spark = view.source.sparkSession
    first = number_keys(view.source.where("order_id < 'O3'"), "order_id")
    assert sorted(tuples(first)) == [("O1", 1), ("O2", 2)]
    numbers = number_keys(view.source, "order_id", first)
    assert sorted(tuples(numbers)) == [("O1", 1), ("O2", 2), ("O3", 3), ("O40000", 4)]
    assert tuples(number_keys(spark.createDataFrame([], "order_id string"), "order_id")) == []
    joined = view.source.join(numbers.withColumnRenamed("key", "order_id"), "order_id", "left")
    rolled = roll_up(SHIPMENT_METRICS.on(joined), FINE, key_number="number")
    same(rolled.query(ALL, by=["product_category"]), view.query(ALL, by=["product_category"]))


def test_many_keys_by_brute_force(spark):
    df = spark.range(100_000).select(
        F.expr("concat('O', id * 7 % 70001)").alias("order_id"), F.expr("date_add(date'2025-01-01', cast(id % 60 as int))").alias("order_date"),
        F.expr("concat('C', id % 3)").alias("product_category"), F.lit("Delivered").alias("order_status"),
    )
    view = SHIPMENT_METRICS.on(df)
    rolled = roll_up(view, FINE, ["total_orders", "fill_rate"], NUMBER)
    assert rolled.table.select("key_bucket").distinct().count() in (buckets_of(70001), buckets_of(70001) + 1)
    same(rolled.query(["total_orders", "fill_rate"], by=["order_month"]), view.query(["total_orders", "fill_rate"], by=["order_month"]))


def test_scattered_keys_take_no_more_than_their_rows(spark):
    """Keys that lie far from each other within a day, with numbers at the edges of words and buckets."""
    df = spark.range(3000).select(
        F.expr("concat('O', id * 32767 + id % 3)").alias("order_id"), F.expr("date_add(date'2025-01-01', cast(id % 50 as int))").alias("order_date"),
        F.lit("C").alias("product_category"), F.expr("if(id % 4 = 0, 'Cancelled', 'Delivered')").alias("order_status"),
    )
    view = SHIPMENT_METRICS.on(df)
    rolled = roll_up(view, FINE, ["total_orders", "fill_rate"], NUMBER)
    assert rolled.table.count() <= 3000
    assert not {"binary", "string"} & {t for c, t in rolled.table.dtypes if c not in FINE}
    same(rolled.query(["total_orders", "fill_rate"], by=["order_month"]), view.query(["total_orders", "fill_rate"], by=["order_month"]))
    plan = rolled.query(["fill_rate"], by=["order_month"])._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
