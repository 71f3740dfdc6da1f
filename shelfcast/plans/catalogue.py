"""Questions and the analyses that answer them."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..sources.contracts import FORECASTS, INVENTORY, SHIPMENTS
from . import analyses


@dataclass(frozen=True)
class Question:
    """``run`` takes the named ``tables`` in order, then the analysis's own parameters."""

    text: str
    run: Callable[..., DataFrame]
    tables: tuple[str, ...]


_S, _I, _F = SHIPMENTS.table, INVENTORY.table, FORECASTS.table

QUESTIONS = {
    "below_reorder": Question(
        "Which products are at or below their reorder point now?", analyses.below_reorder, (_I,)
    ),
    "below_reorder_brief": Question(
        "Which products are low, fewest units first?", analyses.below_reorder_brief, (_I,)
    ),
    "reorder_by_lead_time": Question(
        "What has to be bought today, slowest supplier first?",
        analyses.reorder_by_lead_time,
        (_I,),
    ),
    "inventory_value_by_warehouse": Question(
        "What is the stock of each warehouse worth?",
        analyses.inventory_value_by_warehouse,
        (_I,),
    ),
    "volume_by_warehouse": Question(
        "How much has each warehouse shipped?", analyses.volume_by_warehouse, (_S,)
    ),
    "recent_volume_by_warehouse": Question(
        "How much has each warehouse shipped in the last three months?",
        analyses.recent_volume_by_warehouse,
        (_S,),
    ),
    "fill_rate_by_category": Question(
        "What share of orders is delivered, by category?", analyses.fill_rate_by_category, (_S,)
    ),
    "revenue_by_region": Question(
        "How much does each destination region bring in?", analyses.revenue_by_region, (_S,)
    ),
    "low_fill_rate_warehouses": Question(
        "Which warehouses deliver less than 95 percent of their orders?",
        analyses.low_fill_rate_warehouses,
        (_S,),
    ),
    "forecast_accuracy_by_category": Question(
        "How good are the forecasts, by category?", analyses.forecast_accuracy_by_category, (_F,)
    ),
    "forecast_accuracy_brief": Question(
        "What is the forecast accuracy of each category?", analyses.forecast_accuracy_brief, (_F,)
    ),
    "actual_vs_forecast": Question(
        "How do actual and forecast demand of a category compare since a date?",
        analyses.actual_vs_forecast,
        (_F,),
    ),
    "days_of_supply_by_category": Question(
        "How many days does the stock last, by category?",
        analyses.days_of_supply_by_category,
        (_I, _S),
    ),
    "stockout_risk": Question(
        "Which products may run out this week?", analyses.stockout_risk, (_I, _S)
    ),
}


def answer(name: str, tables: Mapping[str, DataFrame], **params) -> DataFrame:
    """Run the question ``name`` over ``tables`` (contract table name to DataFrame)."""
    question = QUESTIONS.get(name)
    if question is None:
        raise KeyError(f"no question called {name!r}; known: {sorted(QUESTIONS)}")
    return question.run(*[tables[t] for t in question.tables], **params)
