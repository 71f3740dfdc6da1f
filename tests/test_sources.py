import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import tuples
from shelfcast.sources.contracts import CONTRACTS, FORECASTS, SHIPMENTS, conform
from shelfcast.sources.sample import (
    PRODUCTS,
    WAREHOUSES,
    regions_of,
    sample_products,
    sample_warehouses,
)
from shelfcast.sources.spines import date_spine, with_dates, year_span


def test_contracts_are_complete():
    assert {n: len(c.fields) for n, c in CONTRACTS.items()} == {
        "shipment_orders": 12, "inventory_levels": 11, "demand_forecasts": 11,
    }
    assert all(f.comment for c in CONTRACTS.values() for f in c.fields)


def test_conform_casts_renames_and_documents(spark):
    raw = spark.createDataFrame(
        [("A", "n", "c", "2025-10-01", 5, 1, 9, 6, "v1", "N")],
        "sku string, product_name string, product_category string, forecast_date string, "
        "predicted_demand long, confidence_lower int, confidence_upper int, actual_demand int, "
        "model_version string, region string",
    )
    got = conform(raw, FORECASTS, {"product_sku": "sku", "forecast_error_pct": F.lit(16.7)})
    assert got.columns == FORECASTS.columns
    assert dict(got.dtypes) == {f.name: f.type for f in FORECASTS.fields}
    assert got.schema["region"].metadata["comment"] == FORECASTS.comments["region"]
    assert got.first().forecast_date == dt.date(2025, 10, 1)


def test_conform_widens_mixed_price_scales(spark):
    raw = spark.createDataFrame([(Decimal("32.5"),), (Decimal("8.9"),)], "price decimal(3,1)")
    rest = {f.name: F.lit(None) for f in SHIPMENTS.fields}
    got = conform(raw, SHIPMENTS, {**rest, "unit_price": "price"})
    assert sorted(r.unit_price for r in got.collect()) == [Decimal("8.90"), Decimal("32.50")]


def test_conform_names_what_is_wrong(spark):
    df = spark.range(1)
    with pytest.raises(ValueError, match="no source given for .*region"):
        conform(df, FORECASTS)
    with pytest.raises(ValueError, match=r"no columns \['sku'\]"):
        conform(df, FORECASTS, {"sku": "id"})


def test_spines_include_both_ends(spark):
    start, end = dt.date(2024, 1, 1), dt.date(2024, 12, 31)
    days = [r[0] for r in date_spine(spark, "d", start, end, "day").collect()]
    assert (len(days), days[0], days[-1]) == (366, start, end)
    weeks = [r[0] for r in date_spine(spark, "d", start, end, "week").collect()]
    assert len(weeks) == 53 and (weeks[1] - weeks[0]).days == 7
    months = [r[0] for r in date_spine(spark, "d", start, end, "month").collect()]
    assert months == [dt.date(2024, m, 1) for m in range(1, 13)]


def test_with_dates_keeps_rows_and_partitions(spark):
    df = spark.range(10).repartition(3)
    got = with_dates(df, "d", dt.date(2025, 1, 1), dt.date(2025, 1, 4), "day")
    assert got.count() == 40
    assert got.select(F.spark_partition_id()).distinct().count() == 3


def test_year_span():
    assert year_span() == (dt.date(2025, 1, 1), dt.date(2025, 12, 31))
    assert year_span(5) == (dt.date(2021, 1, 1), dt.date(2025, 12, 31))
    with pytest.raises(ValueError, match="scale must be >= 1"):
        year_span(0)


def test_sample_dimensions(spark):
    assert len(PRODUCTS) == 20 and len({p[0] for p in PRODUCTS}) == 20
    assert len(WAREHOUSES) == 8
    prices = {r.product_sku: r.unit_price for r in sample_products(spark).collect()}
    assert prices["SKU-AP-012"] == Decimal("32.50")
    # two of the eight warehouses share a region
    assert tuples(regions_of(sample_warehouses(spark))) == [
        ("Great Lakes",), ("Midwest",), ("Mountain",), ("Northeast",), ("Pacific",),
        ("South Central",), ("Southeast",),
    ]
