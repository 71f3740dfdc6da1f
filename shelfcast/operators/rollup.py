"""Stored rollups of a metric view: aggregated once, asked at any coarser grain.

Sums and counts add up from finer groups to coarser ones; distinct counts don't. A rollup therefore
keeps, beside the sums, which keys a group has seen, as bits: each key has a number, numbers are cut
into buckets of 32,768 and these into words of 64, and a group has one row for each word it touches.
Merging groups is a bitwise OR, so the distinct counts stay exact at every grain. However the numbers
lie, a rollup has no more rows than its source, and all its columns are of fixed width, so Spark
aggregates them by hash.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from .metrics import MetricView, Term, _resolves
from .pairing import shuffle_width
from .ranges import range_bucket, range_cuts
from .ranking import global_rank

BUCKET = "key_bucket"
WORD = "key_word"
BITS_IN_WORD = 64


@dataclass(frozen=True)
class Rollup:
    """``table`` holds one row for each combination of ``by``, bucket and word of key numbers.

    Rows of several loads may stand side by side: every question aggregates again, so a new day
    is an append of its own rollup (``roll_up(...).table``), and ``compacted`` merges what has piled up.
    """

    view: MetricView
    by: tuple[str, ...]
    terms: Mapping[Term, str]
    table: DataFrame

    def on(self, table: DataFrame) -> Rollup:
        """The same definitions over a stored table, such as one written from ``table``."""
        return replace(self, table=table)

    def compacted(self) -> Rollup:
        """One row for each combination of dimensions, bucket and word."""
        merged = self._merged(self.table, self.by)
        return self.on(merged.select(*self.table.columns))

    def query(
        self,
        measures: Sequence[str],
        by: Sequence[str] = (),
        where: Column | str | None = None,
        having: Column | str | None = None,
        order_by: Sequence[str] = (),
    ) -> DataFrame:
        """``measures`` for each combination of ``by``, as ``MetricView.query`` gives them.

        ``by`` and ``where`` may name the rollup's own dimensions and those that the view derives
        from them (months of a rollup by day). ValueError for a measure or a dimension that the
        rollup does not hold.
        """
        self.view._check(measures, self.view.measures, "measure")
        wanted = [self.view.measures[m] for m in measures]
        needed = list(dict.fromkeys(t for m in wanted for t in m.terms.values()))
        absent = [m.name for m in wanted if not set(m.terms.values()) <= set(self.terms)]
        if absent:
            raise ValueError(f"the rollup of {self.view.name} does not hold {absent}")

        df = self.table
        derived = {
            name: F.expr(formula)
            for name, formula in self.view.dimensions.items()
            if name not in self.by and (name in by or where is not None) and _resolves(df, formula)
        }
        known = [*self.by, *derived]
        unknown = [d for d in by if d not in known]
        if unknown:
            raise ValueError(f"the rollup of {self.view.name} has no dimension {unknown}; it has {sorted(known)}")
        df = df.withColumns(derived)
        if where is not None:
            df = df.where(where)

        types = dict(self.table.dtypes)
        names = {t: n for t, n in self.terms.items() if t in needed}
        inner = self._merged(df, by, names)
        result = inner.groupBy(*by).agg(*[_final(t, n, types).alias(n) for t, n in names.items()])
        result = result.select(*by, *[m.column(names) for m in wanted])
        if having is not None:
            result = result.where(having)
        if order_by:
            result = result.orderBy(
                *[F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order_by]
            )
        return result

    def _merged(
        self, df: DataFrame, by: Sequence[str], names: Mapping[Term, str] | None = None
    ) -> DataFrame:
        types = dict(self.table.dtypes)
        parts = [
            c for term, name in (names or self.terms).items() for c in _merge_parts(term, name, types)
        ]
        return df.groupBy(*by, BUCKET, WORD).agg(*parts)


def roll_up(
    view: MetricView,
    by: Sequence[str],
    measures: Sequence[str] | None = None,
    key_number: str | None = None,
) -> Rollup:
    """The rollup of ``view`` by the dimensions ``by``, for ``measures`` (all by default).

    ``key_number`` is a SQL expression that gives each distinct-counted key an integer of its own:
    different keys must have different numbers, NULL where the key is. Numbers that lie close to
    each other within a group (keys numbered by date, say) share words and make the rollup smaller
    than its source. Text keys without such a number get one from ``number_keys``. A rollup holds
    distinct counts of one key.

    Rows are combined before the shuffle, which moves one row for each task, group and word.
    """
    if view.source is None:
        raise ValueError(f"{view.name} has no source; bind one with on()")
    measures = list(view.measures if measures is None else measures)
    view._check(measures, view.measures, "measure")
    view._check(by, view.dimensions, "dimension")
    terms = list(dict.fromkeys(t for m in measures for t in view.measures[m].terms.values()))
    keys = {t.expr for t in terms if t.kind == "distinct"}
    if len(keys) > 1:
        raise ValueError(f"a rollup counts one key, not {sorted(keys)}")
    if keys and key_number is None:
        raise ValueError(f"distinct counts of {keys.pop()} need key_number")

    names = {t: f"term_{i}" for i, t in enumerate(terms)}
    number = F.expr(key_number).cast("bigint") if keys else F.lit(None).cast("bigint")
    df = view.source.withColumns(
        {name: F.expr(view.dimensions[name]) for name in by if view.dimensions[name] != name}
    ).withColumn("__number", number)
    parts = [c for term, name in names.items() for c in _first_parts(term, name)]
    bucket = F.bitmap_bucket_number("__number").alias(BUCKET)
    word = F.floor(F.bitmap_bit_position("__number") / BITS_IN_WORD).cast("int").alias(WORD)
    table = df.groupBy(*by, bucket, word).agg(*parts)
    return Rollup(view, tuple(by), names, table)


def number_keys(df: DataFrame, key: str, known: DataFrame | None = None) -> DataFrame:
    """``(key, number)`` of every distinct key of ``df``, numbered from 1 in the order of the keys.

    ``known`` is an earlier result: its numbers stay, and only new keys follow, numbered from its
    largest number on. NULL keys have no number. The numbering is a rank over sampled ranges, without
    a window in one task. Join the result to the rows to use ``number`` as ``key_number``.
    """
    keys = df.select(F.col(key).alias("key")).where(F.col("key").isNotNull()).distinct()
    first: Column = F.lit(0).cast("bigint")
    if known is not None:
        keys = keys.join(known.select("key"), "key", "left_anti")
        first = F.coalesce(known.agg(F.max("number")).scalar(), first)
    cuts = range_cuts(keys, "key", shuffle_width(keys))
    ranked = global_rank(
        keys.withColumns({"__all": F.lit(0), "__range": range_bucket("key", cuts)}),
        "number", "__all", "__range", ["key"],
    )
    ranked = ranked.select("key", (F.col("number") + first).cast("bigint").alias("number"))
    return ranked if known is None else known.select("key", "number").unionByName(ranked)


def buckets_of(keys: int) -> int:
    """How many buckets hold ``keys`` numbers that follow each other."""
    return math.ceil(keys / 32768)


def _first_parts(term: Term, name: str) -> list[Column]:
    if term.kind != "distinct":
        return term.per_key(name)
    bit = F.expr(f"shiftleft(1L, cast(bitmap_bit_position(__number) % {BITS_IN_WORD} as int))")
    seen = bit if term.where is None else F.when(F.expr(term.where), bit)
    return [F.bit_or(seen).alias(name)]


def _merge_parts(term: Term, name: str, types: Mapping[str, str]) -> list[Column]:
    """Sums keep the type they are stored in, as every further sum of decimals would widen it."""
    if term.kind == "distinct":
        return [F.bit_or(name).alias(name)]
    columns = [name, f"{name}_n"] if term.kind == "mean" else [name]
    return [F.sum(c).cast(types[c]).alias(c) for c in columns]


def _final(term: Term, name: str, types: Mapping[str, str]) -> Column:
    if term.kind == "distinct":
        return F.coalesce(F.sum(F.bit_count(name)), F.lit(0))
    if term.kind == "mean":
        return F.sum(name) / F.nullif(F.sum(f"{name}_n"), F.lit(0))
    total = F.sum(name).cast(types[name])
    return F.coalesce(total, F.lit(0)) if term.kind == "count" else total
