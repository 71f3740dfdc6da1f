"""Metric views as permanent catalog views: defined once, read back by name in any session.

A registered metric view is an ordinary view over its table, with the derived dimensions as further
columns, so it can be selected from as it is. Its dimensions and measures travel as JSON in the
view's properties; ``load_metric_view`` makes them a ``MetricView`` again, at any grain.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from ..operators.metrics import Measure, MetricView, Term
from ..operators.views import METRIC_VIEWS

PREFIX = "shelfcast.metric_view"
#: Characters of one property: metastores cut off longer values.
PART = 3000


def sql_text(value: str) -> str:
    """``value`` as a SQL string literal."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r")
    # variables are substituted inside literals too
    return "'" + escaped.replace("$", "\\u0024") + "'"


def quoted(name: str) -> str:
    """Each part of a dotted name of plain identifiers, in backticks."""
    return ".".join("`" + part.replace("`", "``") + "`" for part in name.split("."))


def properties(spark: SparkSession, name: str) -> dict[str, str]:
    """The properties of a table or view."""
    return {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {quoted(name)}").collect()}


def definition(view: MetricView, source: str) -> str:
    """Names, dimensions and measures of ``view`` over the table ``source``, as JSON."""
    measures = [
        {
            "name": m.name, "comment": m.comment, "formula": m.formula,
            "terms": {label: [t.kind, t.expr, t.where] for label, t in m.terms.items()},
        }
        for m in view.measures.values()
    ]
    return json.dumps(
        {
            "name": view.name, "source": source, "time_column": view.time_column,
            "dimensions": dict(view.dimensions), "measures": measures,
        }
    )


def from_definition(text: str) -> tuple[MetricView, str]:
    """The view without its source, and the source's name."""
    told = json.loads(text)
    measures = {
        m["name"]: Measure(m["name"], m["comment"], {k: Term(*t) for k, t in m["terms"].items()}, m["formula"])
        for m in told["measures"]
    }
    return MetricView(told["name"], told["dimensions"], measures, told["time_column"]), told["source"]


def save_metric_view(
    spark: SparkSession, view: MetricView, name: str, source: str, extra: Mapping[str, str] | None = None
) -> None:
    """Register ``view`` over the table ``source`` as the permanent view ``name``.

    A metric view of that name is replaced in one statement, so readers see the old or the new one;
    a table or another view is left as it is, with an error. All dimensions and measures are resolved
    against the source first: a definition that can't be queried isn't saved. ``extra``: further
    properties.
    """
    if spark.catalog.tableExists(name) and PREFIX not in properties(spark, name):
        raise ValueError(f"{name} is not a metric view and is not replaced")
    table = spark.table(source)
    _ = view.on(table).query(list(view.measures), by=list(view.dimensions)).schema
    text = definition(view, source)
    parts = [text[i : i + PART] for i in range(0, len(text), PART)]
    told = {PREFIX: str(len(parts)), **{f"{PREFIX}.{i}": p for i, p in enumerate(parts)}, **(extra or {})}
    listed = ", ".join(f"{sql_text(k)} = {sql_text(v)}" for k, v in told.items())
    derived = "".join(
        f", {expression} AS {quoted(dimension)}"
        for dimension, expression in view.dimensions.items()
        if dimension not in table.columns
    )
    comment = sql_text(f"Metric view {view.name}: {', '.join(view.measures)}")
    spark.sql(
        f"CREATE OR REPLACE VIEW {quoted(name)} COMMENT {comment} TBLPROPERTIES ({listed}) "
        f"AS SELECT *{derived} FROM {quoted(source)}"
    )


def load_metric_view(spark: SparkSession, name: str) -> MetricView | None:
    """The registered metric view ``name`` over its table; None if there is no such view."""
    try:
        if not spark.catalog.tableExists(name):
            return None
    except AnalysisException:  # a namespace that the catalog can't have
        return None
    told = properties(spark, name)
    if PREFIX not in told:
        return None
    view, source = from_definition("".join(told[f"{PREFIX}.{i}"] for i in range(int(told[PREFIX]))))
    return view.on(spark.table(source))


def drop_metric_view(spark: SparkSession, name: str) -> bool:
    """Drop a registered metric view; False if there is none. Anything else of that name stays."""
    if load_metric_view(spark, name) is None:
        return False
    spark.sql(f"DROP VIEW {quoted(name)}")
    return True


def list_metric_views(spark: SparkSession, schema: str) -> list[str]:
    """Names of the metric views registered in ``schema``."""
    views = spark.sql(f"SHOW VIEWS IN {quoted(schema)}").where("NOT isTemporary").collect()
    names = [f"{schema}.{r['viewName']}" for r in views]
    return sorted(n.rpartition(".")[2] for n in names if PREFIX in properties(spark, n))


def metric_view(spark: SparkSession, name: str) -> MetricView:
    """The metric view called ``[catalog.]schema.view``: what is registered under that name, else the
    library's own view of that name over the schema's table."""
    found = load_metric_view(spark, name)
    if found:
        return found
    schema, _, view = name.rpartition(".")
    if view not in METRIC_VIEWS:
        raise KeyError(f"no metric view called {view!r}; known: {sorted(METRIC_VIEWS)}")
    table = view.removesuffix("_metrics")
    return METRIC_VIEWS[view].on(spark.table(f"{schema}.{table}" if schema else table))
