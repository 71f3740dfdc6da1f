"""Adapters over hand-made order-processing tables."""

import datetime as dt

import pytest

from conftest import tuples
from shelfcast.sources import adapters
from shelfcast.sources.contracts import FORECASTS, INVENTORY, SHIPMENTS

JAN, JUN = dt.datetime(2001, 1, 31), dt.datetime(2001, 6, 1)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    tables = {
        "region": ([(0, "AFRICA"), (1, "ASIA")], "r_regionkey int, r_name string"),
        "nation": ([(0, "N0", 0), (1, "N1", 1)], "n_nationkey int, n_name string, n_regionkey int"),
        # customer 9 lives nowhere
        "customer": ([(1, 0), (2, 1), (9, 77)], "c_custkey long, c_nationkey int"),
        "supplier": (
            [(k, f"S{k}", k % 2) for k in range(8)],
            "s_suppkey long, s_name string, s_nationkey int",
        ),
        "part": (
            [(0, "bolt", "B1", "SMALL", 5, 1.1), (1, "nut", "B1", "SMALL", 1, 2.0)],
            "p_partkey long, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
        ),
        # order 4 has no lines
        "orders": (
            [(1, 1, "F", JAN), (2, 2, "P", JAN), (3, 9, "O", JUN), (4, 1, "F", JUN)],
            "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz",
        ),
        # line of order 3 is for a part that is not listed; order 8 does not exist
        "lineitem": (
            [
                (1, 0, 3, 100000000.0, "R", "F"),
                (1, 1, 3, 5.0, "N", "O"),
                (2, 0, 4, 2.0, "R", "F"),
                (2, 0, 4, 3.0, "N", "F"),
                (3, 99, 5, 4.0, "N", "O"),
                (3, 1, 5, 6.0, "N", "F"),
                (8, 0, 3, 9.0, "N", "F"),
            ],
            "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, "
            "l_returnflag string, l_linestatus string",
        ),
    }
    for name, (rows, schema) in tables.items():
        df = spark.createDataFrame(rows, schema)
        if name == "lineitem":
            df = df.selectExpr("*", "timestamp_ntz'2001-02-03 00:00:00' as l_shipdate")
        df.write.parquet(str(root / f"{name}.parquet"))
    return str(root)


def test_shipments(spark, sf_dir):
    got = adapters.shipments(spark, sf_dir)
    assert dict(got.dtypes) == {f.name: f.type for f in SHIPMENTS.fields}
    rows = sorted(
        (r.order_id, r.quantity, r.order_status, r.product_category, r.destination_region)
        for r in got.fillna("?").collect()
    )
    assert rows == [
        ("ORD-000000001", 5, "Delivered", "SMALL", "AFRICA"),
        ("ORD-000000001", 100000000, "Delivered", "SMALL", "AFRICA"),
        ("ORD-000000002", 2, "Cancelled", "SMALL", "ASIA"),
        ("ORD-000000002", 3, "Backorder", "SMALL", "ASIA"),
        ("ORD-000000003", 4, "In Transit", "?", "?"),
        ("ORD-000000003", 6, "Delivered", "SMALL", "?"),
    ]


@pytest.mark.parametrize("column", SHIPMENTS.columns)
def test_each_column_alone_has_all_rows(spark, sf_dir, column):
    alone = adapters.shipments(spark, sf_dir, [column])
    full = adapters.shipments(spark, sf_dir).select(column)
    assert sorted(tuples(alone), key=str) == sorted(tuples(full), key=str)


def test_inventory(spark, sf_dir):
    got = adapters.inventory(spark, sf_dir)
    assert dict(got.dtypes) == {f.name: f.type for f in INVENTORY.fields}
    assert got.count() == 2 * 4 * 8
    # eight suppliers: stores of a part are two apart
    assert {r[0] for r in got.where("product_sku = '1'").select("warehouse_id").collect()} == {
        "1", "3", "5", "7",
    }
    row = got.where(
        "product_sku = '1' and warehouse_id = '3' and snapshot_date = '2001-06-20'"
    ).first()
    assert (row.reorder_point, row.safety_stock_qty, row.lead_time_days) == (24, 12, 7)
    assert row.quantity_on_hand == (31 * 1 + 17 * 3 + 13 * 2) % 96


def test_forecasts_of_large_months_do_not_overflow(spark, sf_dir):
    got = adapters.forecasts(spark, sf_dir)
    assert dict(got.dtypes) == {f.name: f.type for f in FORECASTS.fields}
    row = got.where("region = 'AFRICA'").first()
    # January, region 0: bias 88 + 7 percent of 100,000,005 units
    assert (row.forecast_date, row.actual_demand, row.predicted_demand) == (
        dt.date(2001, 1, 1), 100000005, 95000004,
    )
    assert (row.confidence_lower, row.confidence_upper) == (78850003, 109250004)
    assert (row.forecast_error_pct, row.model_version) == (5.0, "v3.0")


def test_supplier_numbering_loses_no_rows(spark, tmp_path):
    """Equal row counts whether supplier keys start at 0, at 1, or have gaps."""
    part = spark.range(12).selectExpr(
        "id as p_partkey", "concat('n', id) as p_name", "'b' as p_brand", "'SMALL' as p_type",
        "int(id % 5) as p_size", "double(id) as p_retailprice",
    )
    counts = set()
    for name, key in (("zero", "id"), ("one", "id + 1"), ("gaps", "id * id * 3 + 7")):
        folder = str(tmp_path / name)
        part.write.parquet(f"{folder}/part.parquet")
        spark.range(9).selectExpr(
            f"{key} as s_suppkey", "concat('s', id) as s_name", "int(id) as s_nationkey", "0d as s_acctbal"
        ).write.parquet(f"{folder}/supplier.parquet")
        counts.add(adapters.inventory(spark, folder).count())
    assert counts == {12 * 4 * 8}


def test_unfolded_parts_are_not_broadcast(spark, tmp_path):
    """The file of the parts is far below the broadcast threshold, their unfolded rows are not."""
    parts = spark.range(40_000).selectExpr(
        "id as p_partkey", "'bolt' as p_name", "'B1' as p_brand", "'SMALL' as p_type", "5 as p_size", "1.1D as p_retailprice"
    )
    parts.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    stores = spark.range(8).selectExpr("id as s_suppkey", "concat('S', id) as s_name", "0 as s_nationkey")
    stores.coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    limit = "spark.sql.maxBroadcastTableSize"
    old = spark.conf.get(limit)
    spark.conf.set(limit, "4m")
    try:
        assert adapters.inventory(spark, str(tmp_path)).count() == 40_000 * 4 * 8
    finally:
        spark.conf.set(limit, old)


def test_parts_of_order_lines_are_not_broadcast(spark, tmp_path):
    """Parts that compress to a file far below the broadcast threshold are too large for the driver."""
    parts = spark.range(100_000).selectExpr(
        "id as p_partkey", "'bolt' as p_name", "'B1' as p_brand", "'SMALL' as p_type", "5 as p_size", "1.1D as p_retailprice"
    )
    parts.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    spark.range(10).selectExpr(
        "id as o_orderkey", "id as o_custkey", "'O' as o_orderstatus", "timestamp'2001-01-01' as o_orderdate"
    ).write.parquet(str(tmp_path / "orders.parquet"))
    lines = spark.range(10).selectExpr(
        "id as l_orderkey", "id * 20000 as l_partkey", "1L as l_suppkey", "1D as l_quantity", "'A' as l_returnflag",
        "'O' as l_linestatus", "timestamp'2001-01-02' as l_shipdate",
    )
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    limit = "spark.sql.maxBroadcastTableSize"
    old = spark.conf.get(limit)
    spark.conf.set(limit, "4m")
    try:
        got = adapters.shipments(spark, str(tmp_path), ["order_id", "product_category"])
        # parts 100,000 and above are not there
        assert sorted(str(r.product_category) for r in got.collect()) == ["None"] * 5 + ["SMALL"] * 5
    finally:
        spark.conf.set(limit, old)


def test_numbered_suppliers_are_not_broadcast(spark, tmp_path):
    """Numbering needs one offset for each range of keys; the suppliers themselves stay off the driver."""
    parts = spark.range(5).selectExpr(
        "id as p_partkey", "'bolt' as p_name", "'B1' as p_brand", "'SMALL' as p_type", "5 as p_size", "1.1D as p_retailprice"
    )
    parts.write.parquet(str(tmp_path / "part.parquet"))
    stores = spark.range(400_000).selectExpr("id as s_suppkey", "'S' as s_name", "0 as s_nationkey", "0d as s_acctbal")
    stores.coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    limit = "spark.sql.maxBroadcastTableSize"
    old = spark.conf.get(limit)
    spark.conf.set(limit, "4m")
    try:
        assert adapters.inventory(spark, str(tmp_path)).count() == 5 * 4 * 8
    finally:
        spark.conf.set(limit, old)
