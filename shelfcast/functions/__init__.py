from .expressions import (
    accuracy_pct,
    demand_variance,
    error_pct,
    month_start,
    padded_key,
    quarter_start,
    safe_div,
    stock_status_3,
    stock_status_4,
)
from .noise import noise_fraction, noise_int
from .predicates import (
    at_latest,
    below_reorder_point,
    below_safety_stock,
    is_delivered,
    is_weekday,
    newest,
    trailing_months,
)

__all__ = [
    "accuracy_pct",
    "at_latest",
    "below_reorder_point",
    "below_safety_stock",
    "demand_variance",
    "error_pct",
    "is_delivered",
    "is_weekday",
    "month_start",
    "newest",
    "noise_fraction",
    "noise_int",
    "padded_key",
    "quarter_start",
    "safe_div",
    "stock_status_3",
    "stock_status_4",
    "trailing_months",
]
