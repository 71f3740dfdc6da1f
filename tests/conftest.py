from __future__ import annotations

import datetime as dt
import sys
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from shelfcast.session import local_session  # noqa: E402
from shelfcast.sources.contracts import FORECASTS, INVENTORY, SHIPMENTS  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(
        4,
        "shelfcast-tests",
        {
            "spark.sql.shuffle.partitions": "4",
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def ddl(contract):
    return ", ".join(f"{f.name} {f.type}" for f in contract.fields)


@pytest.fixture(scope="session")
def make_shipments(spark):
    def make(*rows):
        """Rows of (order, date, sku, category, quantity, price, warehouse, region, status)."""
        full = [
            (
                order, dt.date.fromisoformat(day), "C1", sku, f"name {sku}", category, quantity,
                Decimal(price), store, region, dt.date.fromisoformat(day), status,
            )
            for order, day, sku, category, quantity, price, store, region, status in rows
        ]
        return spark.createDataFrame(full, ddl(SHIPMENTS))

    return make


@pytest.fixture(scope="session")
def make_inventory(spark):
    def make(*rows):
        """Rows of (sku, category, warehouse, date, on hand, reorder, safety, lead, cost)."""
        full = [
            (
                sku, f"name {sku}", category, store, f"name {store}", dt.date.fromisoformat(day),
                on_hand, reorder, safety, lead, Decimal(cost),
            )
            for sku, category, store, day, on_hand, reorder, safety, lead, cost in rows
        ]
        return spark.createDataFrame(full, ddl(INVENTORY))

    return make


@pytest.fixture(scope="session")
def make_forecasts(spark):
    def make(*rows):
        """Rows of (sku, category, month, predicted, actual, error, model, region)."""
        full = [
            (
                sku, f"name {sku}", category, dt.date.fromisoformat(day), predicted, 0, 0,
                actual, error, model, region,
            )
            for sku, category, day, predicted, actual, error, model, region in rows
        ]
        return spark.createDataFrame(full, ddl(FORECASTS))

    return make


def tuples(df):
    return [tuple(r) for r in df.collect()]
