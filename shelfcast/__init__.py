"""Shipment, inventory and demand-forecast analytics on Spark DataFrames."""

from .operators.compare import compare, difference_counts, row_differences
from .operators.dictionary import format_profile, value_dictionary
from .operators.metrics import Measure, MetricView, distinct, mean, rows, total
from .operators.ordering import order_violations
from .operators.rollup import number_keys, roll_up
from .operators.snippets import SNIPPETS, snippet
from .operators.top_values import top_values
from .operators.views import (
    FORECAST_METRICS,
    INVENTORY_METRICS,
    METRIC_VIEWS,
    SHIPMENT_METRICS,
)
from .plans.benchmarks import BENCHMARKS, check_answers
from .plans.catalogue import QUESTIONS, answer
from .plans.sql_functions import register_functions
from .sources.contracts import CONTRACTS, FORECASTS, INVENTORY, SHIPMENTS, Contract, conform
from .sources.metric_catalog import drop_metric_view, list_metric_views, metric_view, save_metric_view
from .sources.store import deploy, deployment_record, materialize, teardown
from .sources.tables import catalog_tables

__all__ = [
    "BENCHMARKS",
    "CONTRACTS",
    "Contract",
    "FORECASTS",
    "FORECAST_METRICS",
    "INVENTORY",
    "INVENTORY_METRICS",
    "METRIC_VIEWS",
    "Measure",
    "MetricView",
    "QUESTIONS",
    "SHIPMENTS",
    "SHIPMENT_METRICS",
    "SNIPPETS",
    "answer",
    "catalog_tables",
    "check_answers",
    "compare",
    "conform",
    "deploy",
    "deployment_record",
    "difference_counts",
    "distinct",
    "drop_metric_view",
    "format_profile",
    "list_metric_views",
    "materialize",
    "mean",
    "metric_view",
    "number_keys",
    "order_violations",
    "register_functions",
    "roll_up",
    "row_differences",
    "rows",
    "save_metric_view",
    "snippet",
    "teardown",
    "top_values",
    "total",
    "value_dictionary",
]
