"""Metric views on DataFrames: named dimensions and measures, aggregated at any grain.

A measure is built from *terms* (plain aggregates) and a formula over them. A query asks for
measures by dimensions; terms shared by several measures are computed once, and ratios are
formed from terms at the grain asked for, never averaged from finer ratios.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import at_latest

_KEY, _DAY = "__key", "__day"


@dataclass(frozen=True)
class Term:
    """One aggregate over SQL expressions; ``where`` restricts the rows it sees.

    ``sum`` is NULL without qualifying rows, ``count`` and ``distinct`` are 0, ``mean``
    ignores NULL values.
    """

    kind: str
    expr: str = "1"
    where: str | None = None

    def _value(self) -> Column:
        value = F.expr(self.expr)
        return value if self.where is None else F.when(F.expr(self.where), value)

    def direct(self) -> Column:
        """The aggregate in one step."""
        if self.kind == "sum":
            return F.sum(self._value())
        if self.kind == "count":
            return F.count(self._value())
        if self.kind == "mean":
            return F.avg(self._value().cast("double"))
        return F.count_distinct(self._value())

    def per_key(self, name: str) -> list[Column]:
        """Partial results of the rows that share one distinct-counted key."""
        if self.kind == "sum":
            return [F.sum(self._value()).alias(name)]
        if self.kind == "count":
            return [F.count(self._value()).alias(name)]
        if self.kind == "mean":
            value = self._value().cast("double")
            return [F.sum(value).alias(name), F.count(value).alias(f"{name}_n")]
        seen = F.lit(True) if self.where is None else F.expr(self.where)
        return [F.max(seen).alias(name)]

    def merged(self, name: str) -> Column:
        """Final result from the partial ones."""
        if self.kind == "sum":
            return F.sum(name)
        if self.kind == "count":
            return F.coalesce(F.sum(name), F.lit(0))
        if self.kind == "mean":
            return F.sum(name) / F.nullif(F.sum(f"{name}_n"), F.lit(0))
        return F.count_if(F.col(name) & F.col(_KEY).isNotNull())


def total(expr: str, where: str | None = None) -> Term:
    return Term("sum", expr, where)


def rows(where: str | None = None) -> Term:
    return Term("count", "1", where)


def mean(expr: str) -> Term:
    return Term("mean", expr)


def distinct(expr: str, where: str | None = None) -> Term:
    return Term("distinct", expr, where)


@dataclass(frozen=True)
class Measure:
    """``formula`` is a SQL expression over the term names; ``{a}`` stands for term ``a``."""

    name: str
    comment: str
    terms: Mapping[str, Term]
    formula: str

    def column(self, names: Mapping[Term, str]) -> Column:
        spelled = {label: f"`{names[term]}`" for label, term in self.terms.items()}
        return F.expr(self.formula.format(**spelled)).alias(
            self.name, metadata={"comment": self.comment}
        )


@dataclass(frozen=True)
class MetricView:
    """Dimensions (name to SQL expression) and measures over one source."""

    name: str
    dimensions: Mapping[str, str]
    measures: Mapping[str, Measure]
    time_column: str
    source: DataFrame | None = None

    def on(self, source: DataFrame) -> MetricView:
        """The same definitions over ``source``."""
        return replace(self, source=source)

    def with_dimensions(self, **extra: str) -> MetricView:
        """Further dimensions, as names and SQL expressions."""
        return replace(self, dimensions={**self.dimensions, **extra})

    def with_measures(self, *extra: Measure) -> MetricView:
        return replace(self, measures={**self.measures, **{m.name: m for m in extra}})

    def query(
        self,
        measures: Sequence[str],
        by: Sequence[str] = (),
        where: Column | str | None = None,
        having: Column | str | None = None,
        order_by: Sequence[str] = (),
        as_of: str | None = None,
    ) -> DataFrame:
        """``measures`` for each combination of the dimensions ``by``.

        ``where`` filters rows by source columns and by any dimension, grouped by or not;
        ``having`` filters the result. A dimension is what the view defines, whatever the source
        has under its name. The source needs only the columns that the query touches.
        ``order_by`` names result columns, with a leading ``-`` for descending order.
        ``as_of="latest"`` keeps only the source's newest date, which sums of stock levels
        need: added up over all snapshots they mean nothing. ``as_of="period_end"`` takes every
        combination of dimensions at its own newest date, such as stock by month at the last
        snapshot of each month: terms are aggregated by day first, and a group's last day is taken,
        so what moves is one narrow row for each group and day.
        """
        if self.source is None:
            raise ValueError(f"{self.name} has no source; bind one with on()")
        if as_of not in (None, "latest", "period_end"):
            raise ValueError(f"as_of must be None, 'latest' or 'period_end', not {as_of!r}")
        self._check(measures, self.measures, "measure")
        self._check(by, self.dimensions, "dimension")

        df = self.source
        if as_of == "latest":
            df = at_latest(df, self.time_column)
        derived = {name: formula for name, formula in self.dimensions.items() if formula != name}
        df = df.withColumns(
            {
                name: F.expr(formula)
                for name, formula in derived.items()
                if name in by or where is not None and _resolves(df, formula)
            }
        )
        if where is not None:
            df = df.where(where)

        wanted = [self.measures[m] for m in measures]
        terms = list(dict.fromkeys(t for m in wanted for t in m.terms.values()))
        names = {t: f"__t{i}" for i, t in enumerate(terms)}
        if as_of == "period_end":
            df = df.withColumn(_DAY, F.col(self.time_column))
            by_day = _aggregate(df, [*by, _DAY], names).where(F.col(_DAY).isNotNull())
            last = F.max_by(F.struct(*names.values()), _DAY).alias("__last")
            aggregated = by_day.groupBy(*by).agg(last).select(*by, "__last.*")
        else:
            aggregated = _aggregate(df, list(by), names)
        result = aggregated.select(*by, *[m.column(names) for m in wanted])
        if having is not None:
            result = result.where(having)
        if order_by:
            result = result.orderBy(
                *[F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order_by]
            )
        return result

    def create_view(
        self, view: str, measures: Sequence[str], by: Sequence[str] = ()
    ) -> DataFrame:
        """Register a query of this view as the temporary view ``view``, replacing it."""
        result = self.query(measures, by)
        result.createOrReplaceTempView(view)
        return result

    def _check(self, asked: Sequence[str], known: Mapping, what: str) -> None:
        unknown = [name for name in asked if name not in known]
        if unknown:
            raise ValueError(f"{self.name} has no {what} {unknown}; it has {sorted(known)}")


def _resolves(df: DataFrame, formula: str) -> bool:
    """Whether ``df`` has the columns of ``formula``; those that a query doesn't use are pruned."""
    try:
        _ = df.select(F.expr(formula)).schema
    except AnalysisException:
        return False
    return True


def _aggregate(df: DataFrame, by: list[str], names: Mapping[Term, str]) -> DataFrame:
    """All terms by the dimensions, each under its own name.

    Distinct counts of one key are taken in two ordinary aggregations: to one row per
    (dimensions, key) with a flag for each condition, then to the dimensions. Spark's own
    plan for several conditional distinct counts first copies every row once per count. Both
    steps combine before their shuffle, so a group with a large share of the rows is small
    by the time it moves. Only a query that counts several different keys takes Spark's plan.
    """
    keys = {t.expr for t in names if t.kind == "distinct"}
    if len(keys) != 1:
        return df.groupBy(*by).agg(*[t.direct().alias(n) for t, n in names.items()])
    key = F.expr(keys.pop()).alias(_KEY)
    per_key = df.groupBy(*by, key).agg(*[c for t, n in names.items() for c in t.per_key(n)])
    return per_key.groupBy(*by).agg(*[t.merged(n).alias(n) for t, n in names.items()])
