"""Default dimensions and seasonal profiles of the generators.

Pass your own DataFrames and profiles to the generators to replace any of them.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

PRODUCT_SCHEMA = (
    "product_sku string, product_name string, product_category string, "
    "unit_price decimal(10,2), unit_cost decimal(10,2), reorder_point int, safety_stock_qty int"
)
WAREHOUSE_SCHEMA = "warehouse_id string, warehouse_name string, region string, lead_time_days int"

# The sample products (sku, name, category, price, unit cost, reorder point,
# safety stock) and warehouses (id, name, region, lead time), the seed, and the profiles below.
SEED = 20250306

PRODUCTS = (
    ("SKU-EL-001", "Wireless Bluetooth Speaker", "Electronics", "49.99", "28.50", 100, 50),
    ("SKU-EL-003", "USB-C Hub 7-in-1", "Electronics", "39.99", "22.00", 75, 35),
    ("SKU-EL-007", "Portable Phone Charger 20000mAh", "Electronics", "29.99", "16.50", 100, 50),
    ("SKU-EL-010", "Noise-Cancelling Earbuds", "Electronics", "79.99", "42.00", 80, 40),
    ("SKU-EL-015", "4K Webcam with Ring Light", "Electronics", "64.99", "35.00", 60, 30),
    ("SKU-AP-003", "Cold Brew Coffee Concentrate", "Food & Beverage", "14.99", "7.80", 150, 75),
    ("SKU-AP-012", "Organic Protein Bars (24pk)", "Food & Beverage", "32.50", "18.75", 200, 100),
    ("SKU-AP-018", "Sparkling Water Variety Pack", "Food & Beverage", "22.99", "12.50", 250, 125),
    ("SKU-AP-025", "Premium Trail Mix (12pk)", "Food & Beverage", "27.99", "15.00", 180, 90),
    ("SKU-HG-002", "Stainless Steel Water Bottle", "Home & Garden", "22.50", "12.30", 150, 75),
    ("SKU-HG-005", "Smart LED Bulb (4-pack)", "Home & Garden", "24.99", "14.20", 80, 40),
    ("SKU-HG-009", "Bamboo Cutting Board Set", "Home & Garden", "34.99", "18.50", 60, 30),
    ("SKU-HG-014", "Indoor Herb Garden Kit", "Home & Garden", "42.99", "22.00", 70, 35),
    ("SKU-HL-008", "Vitamin D3 Supplements", "Health & Wellness", "18.99", "8.50", 250, 120),
    ("SKU-HL-015", "Melatonin Sleep Gummies", "Health & Wellness", "12.99", "6.20", 120, 60),
    ("SKU-HL-022", "Probiotic Capsules (60ct)", "Health & Wellness", "24.99", "12.50", 100, 50),
    ("SKU-HL-030", "Collagen Powder (30 servings)", "Health & Wellness", "35.99", "19.00", 90, 45),
    ("SKU-CL-004", "Moisture-Wicking Running Socks", "Clothing & Apparel", "8.99", "4.10", 400, 200),
    ("SKU-CL-011", "Performance Compression Tights", "Clothing & Apparel", "44.99", "24.00", 120, 60),
    ("SKU-CL-019", "Quick-Dry Hiking Shorts", "Clothing & Apparel", "38.99", "20.00", 100, 50),
)

WAREHOUSES = (
    ("WH-EAST-01", "Newark DC", "Northeast", 5),
    ("WH-EAST-02", "Atlanta DC", "Southeast", 5),
    ("WH-CENT-01", "Chicago DC", "Midwest", 4),
    ("WH-CENT-02", "Minneapolis DC", "Great Lakes", 6),
    ("WH-SOUTH-01", "Dallas DC", "South Central", 5),
    ("WH-SOUTH-02", "Miami DC", "Southeast", 4),
    ("WH-WEST-01", "Los Angeles DC", "Pacific", 7),
    ("WH-WEST-02", "Denver DC", "Mountain", 6),
)


@dataclass(frozen=True)
class Seasonal:
    """A usual value and the months (numbers) in which another one holds."""

    usual: Decimal
    peaks: tuple[tuple[tuple[int, ...], Decimal], ...] = ()


@dataclass(frozen=True)
class CategoryProfile:
    """How one product category behaves over the year.

    ``order_rate``: chance that a (day, product, warehouse) sells; ``quantity``: smallest
    order and width of the range above it; ``stock_dip``: share of the reorder point missing
    from the shelf; ``demand``: monthly units; ``demand_season``: factor on them.
    ``category`` None is the profile of every category without one of its own.
    """

    category: str | None
    order_rate: Seasonal
    quantity: tuple[int, int]
    stock_dip: Seasonal
    demand: int
    demand_season: Seasonal


def _seasonal(usual: str, *peaks: tuple[tuple[int, ...], str]) -> Seasonal:
    return Seasonal(Decimal(usual), tuple((months, Decimal(value)) for months, value in peaks))


# Seasonal profiles, in the order of the arguments of CategoryProfile.
PROFILES = (
    CategoryProfile(
        "Electronics",
        _seasonal("0.025", ((11, 12), "0.06")),
        (5, 80),
        _seasonal("0", ((11, 12), "0.5")),
        200,
        _seasonal("1", ((11, 12), "1.8"), ((6, 7), "0.7")),
    ),
    CategoryProfile(
        "Clothing & Apparel",
        _seasonal("0.02", ((3, 4, 9, 10), "0.055")),
        (50, 450),
        _seasonal("0", ((3, 4, 9), "0.3")),
        250,
        _seasonal("1", ((3, 4), "1.5"), ((9, 10), "1.4")),
    ),
    CategoryProfile(
        "Food & Beverage",
        _seasonal("0.035"),
        (30, 250),
        _seasonal("0"),
        350,
        _seasonal("1", ((5, 6, 7), "1.3")),
    ),
    CategoryProfile(
        "Health & Wellness",
        _seasonal("0.03", ((1, 2), "0.05")),
        (20, 280),
        _seasonal("0", ((1, 2), "0.4")),
        300,
        _seasonal("1", ((1, 2), "1.6")),
    ),
    CategoryProfile(
        "Home & Garden",
        _seasonal("0.025", ((4, 5, 6), "0.05")),
        (10, 150),
        _seasonal("0", ((5, 6), "0.3")),
        150,
        _seasonal("1", ((4, 5, 6), "1.5")),
    ),
    CategoryProfile(None, _seasonal("0.03"), (10, 100), _seasonal("0"), 200, _seasonal("1")),
)


def sample_products(spark: SparkSession) -> DataFrame:
    rows = [(*p[:3], Decimal(p[3]), Decimal(p[4]), *p[5:]) for p in PRODUCTS]
    return spark.createDataFrame(rows, PRODUCT_SCHEMA)


def sample_warehouses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(WAREHOUSES), WAREHOUSE_SCHEMA)


def regions_of(warehouses: DataFrame) -> DataFrame:
    """The distinct regions, sorted."""
    return warehouses.select("region").distinct().orderBy("region")
