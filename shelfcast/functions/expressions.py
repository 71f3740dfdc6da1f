"""Column expressions shared by the metric layer, the analyses and the generators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def safe_div(numerator: Column, denominator: Column) -> Column:
    """Quotient that is NULL, not an ANSI error, when the denominator is zero."""
    return numerator / F.nullif(denominator, F.lit(0))


def stock_status_3(
    on_hand: str = "quantity_on_hand",
    reorder: str = "reorder_point",
    safety: str = "safety_stock_qty",
) -> Column:
    """CRITICAL below safety stock, LOW up to the reorder point, HEALTHY above."""
    level = F.col(on_hand)
    return (
        F.when(level < F.col(safety), "CRITICAL")
        .when(level <= F.col(reorder), "LOW")
        .otherwise("HEALTHY")
    )


def stock_status_4(
    on_hand: str = "quantity_on_hand",
    reorder: str = "reorder_point",
    safety: str = "safety_stock_qty",
) -> Column:
    """Four levels: healthy stock ends at twice the reorder point."""
    level = F.col(on_hand)
    return (
        F.when(level < F.col(safety), "Critical")
        .when(level <= F.col(reorder), "Low")
        .when(level <= F.col(reorder) * 2, "Healthy")
        .otherwise("Overstocked")
    )


def month_start(date: str = "order_date") -> Column:
    return F.trunc(F.col(date), "month")


def quarter_start(date: str = "order_date") -> Column:
    return F.trunc(F.col(date), "quarter")


def demand_variance(
    actual: str = "actual_demand", predicted: str = "predicted_demand"
) -> Column:
    return F.col(actual) - F.col(predicted)


def error_pct(
    actual: str = "actual_demand", predicted: str = "predicted_demand"
) -> Column:
    """Absolute error in percent of the actual, one decimal; NULL if the actual is 0."""
    miss = F.abs(demand_variance(actual, predicted))
    return F.round(safe_div(miss, F.col(actual)) * 100, 1)


def accuracy_pct(error: str = "forecast_error_pct") -> Column:
    return F.round(100 - F.col(error), 1)


def padded_key(prefix: str, number: Column, width: int) -> Column:
    """``prefix`` + zero-padded number.

    The pad width grows with the number, because ``lpad`` alone would cut longer
    numbers down to ``width`` digits and make keys collide.
    """
    digits = number.cast("string")
    return F.concat(
        F.lit(prefix), F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), F.lit("0"))
    )
