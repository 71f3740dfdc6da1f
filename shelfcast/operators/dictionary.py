"""What values do the descriptive columns hold, and what do their formats look like?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..sources.contracts import FORECASTS, INVENTORY, SHIPMENTS

# The columns to match words against, and the dates of which only the format counts.
ENTITY_COLUMNS = {
    FORECASTS.table: ("model_version", "product_category", "region"),
    INVENTORY.table: ("product_category", "product_sku", "warehouse_id", "warehouse_name"),
    SHIPMENTS.table: (
        "destination_region", "order_status", "product_category", "product_sku", "warehouse_id",
    ),
}
FORMAT_COLUMNS = {
    FORECASTS.table: ("forecast_date", *ENTITY_COLUMNS[FORECASTS.table]),
    INVENTORY.table: ENTITY_COLUMNS[INVENTORY.table],
    SHIPMENTS.table: ("order_date", *ENTITY_COLUMNS[SHIPMENTS.table]),
}


def value_dictionary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value, row_count) of every value, in one pass over ``df``.

    Rows unfold to one (column, value) pair per column and are counted before the shuffle,
    so a value that most rows share is a single record per task.
    """
    pairs = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], list(columns), "column_name", "value"
    )
    return (
        pairs.where(F.col("value").isNotNull())
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("row_count"))
    )


def format_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: type, smallest and largest value and value count, in one pass."""
    types = dict(df.dtypes)
    facts = [
        f
        for c in columns
        for f in (
            F.min(c).cast("string").alias(f"{c}__min"),
            F.max(c).cast("string").alias(f"{c}__max"),
            F.count(c).alias(f"{c}__n"),
        )
    ]
    described = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit(types[c]).alias("type"),
                F.col(f"{c}__min").alias("min_value"),
                F.col(f"{c}__max").alias("max_value"),
                F.col(f"{c}__n").alias("row_count"),
            )
            for c in columns
        ]
    )
    return df.agg(*facts).select(F.inline(described))
