"""Benchmark questions: given answers against the answers the analyses give."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators.compare import compared
from ..operators.ordering import order_violations
from .catalogue import answer

BENCHMARKS = (
    "below_reorder_brief",
    "forecast_accuracy_brief",
    "volume_by_warehouse",
    "inventory_value_by_warehouse",
    "reorder_by_lead_time",
    "fill_rate_by_category",
    "revenue_by_region",
)


def check_answers(
    answers: Mapping[str, DataFrame],
    tables: Mapping[str, DataFrame] | Callable[[str], Mapping[str, DataFrame]],
    parameters: Mapping[str, Mapping] | None = None,
    digits: int | None = None,
    orders: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """One row per answered benchmark: question, missing and extra rows, and whether it matches.

    Row order does not count, except for the questions in ``orders``: columns that the given answer
    is to be sorted by, with a leading ``-`` for descending. The result then has ``out_of_order``
    too, the rows that sort before the row ahead of them (null where no order is asked for), and an
    answer with such rows does not match. One job takes the fingerprints of all answers; those that differ are
    compared by a lazy query. ``tables`` may be a function
    of the question, which gives it no more columns than it needs. ``parameters`` has the
    arguments of a question's analysis. ``digits``: places that floating numbers must share.
    """
    unknown = sorted(set(answers) - set(BENCHMARKS))
    if unknown or not answers:
        raise ValueError(f"not benchmarks: {unknown}; the benchmarks are {BENCHMARKS}")
    pairs = {
        name: (given, answer(name, tables(name) if callable(tables) else tables, **(parameters or {}).get(name, {})))
        for name, given in answers.items()
    }
    checked = compared(pairs, digits).withColumnRenamed("name", "question")
    if not orders:
        return checked
    if not set(orders) <= set(answers):
        raise ValueError(f"orders of unanswered questions: {sorted(set(orders) - set(answers))}")
    found = reduce(
        DataFrame.unionByName,
        [
            order_violations(answers[name], order).select(F.lit(name).alias("question"), "out_of_order")
            for name, order in orders.items()
        ],
    )
    sorted_ = F.coalesce(F.col("out_of_order") == 0, F.lit(True))
    return checked.join(found, "question", "left").withColumn("matches", F.col("matches") & sorted_)
