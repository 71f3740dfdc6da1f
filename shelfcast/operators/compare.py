"""Answer checking: does a result hold the same rows, as often, as the expected one?

Rows are compared exactly. First each side is reduced to its number of rows and the sums of their
128-bit digests, one line for a whole answer, which moves no rows; only where these differ do the
rows themselves meet, counted on either side.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATING = (T.FloatType, T.DoubleType)
#: Decimal digits of each of the whole types.
_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}
MOST_DIGITS = 38

Parts = Callable[[Column], list[Column]]


def _as_decimal(kind: T.DataType) -> T.DecimalType | None:
    """The decimal type that holds every value of ``kind``."""
    if isinstance(kind, T.DecimalType):
        return kind
    return T.DecimalType(_DIGITS[type(kind)], 0) if isinstance(kind, _WHOLE) else None


def _plain(value: Column) -> list[Column]:
    return [value]


def _decimal_parts(scale: int, whole: int) -> Parts:
    """Decimals in one type where 38 digits hold both, else as whole part and digits behind it."""
    if whole + scale <= MOST_DIGITS:
        return lambda value: [value.cast(T.DecimalType(whole + scale, scale))]

    def parts(value: Column) -> list[Column]:
        rest = (value % F.lit(1)).cast(T.DecimalType(MOST_DIGITS, scale)) if scale else F.lit(None).cast("int")
        return [F.floor(value).cast(T.DecimalType(MOST_DIGITS, 0)), rest]

    return parts


def _floating_parts(other: T.DecimalType, kind: T.DataType, digits: int | None) -> Parts:
    """A double and a decimal are equal if the decimal is what the double is written as.

    Two parts: the value as a decimal of the other side's places, or, where a double has none, the
    double itself, which equals no decimal.
    """
    scale = other.scale if digits is None else min(other.scale, digits)
    exact = T.DecimalType(MOST_DIGITS, scale)

    def parts(value: Column) -> list[Column]:
        if not isinstance(kind, _FLOATING):
            rounded = value if digits is None or other.scale <= digits else F.round(value, digits)
            return [rounded.cast(exact), F.lit(None).cast("double")]
        double = value.cast("double") if digits is None else F.round(value.cast("double"), digits)
        written = double.cast("string").try_cast(exact)
        same = written.cast("string").cast("double") == double
        return [F.when(same, written), F.when(same, F.lit(None)).otherwise(double)]

    return parts


def _parts(one: T.DataType, two: T.DataType, digits: int | None) -> tuple[Parts, Parts] | None:
    """For a column of either side, how to make values that are equal just when the originals are."""
    floating = [isinstance(k, _FLOATING) for k in (one, two)]
    if all(floating):
        if digits is None:
            return (lambda v: [v.cast("double")],) * 2
        return (lambda v: [F.round(v.cast("double"), digits)],) * 2
    if one == two:
        return _plain, _plain
    decimals = [_as_decimal(k) for k in (one, two)]
    if all(decimals):
        scale = max(d.scale for d in decimals)
        whole = max(d.precision - d.scale for d in decimals)
        return (_decimal_parts(scale, whole),) * 2
    known = next((d for d in decimals if d), None)
    if any(floating) and known:
        return _floating_parts(known, one, digits), _floating_parts(known, two, digits)
    return None


def _typed(actual: DataFrame, expected: DataFrame, digits: int | None) -> tuple[DataFrame, DataFrame] | None:
    """Both sides in comparable columns, or None where names or types can't be compared."""
    found = {f.name: f.dataType for f in actual.schema.fields}
    wanted = {f.name: f.dataType for f in expected.schema.fields}
    if found.keys() != wanted.keys():
        return None
    sides: tuple[list[Column], list[Column]] = ([], [])
    for name in expected.columns:
        ways = _parts(found[name], wanted[name], digits)
        if ways is None:
            return None
        for side, way in zip(sides, ways, strict=True):
            side += [part.alias(f"{name}__{i}" if i else name) for i, part in enumerate(way(F.col(f"`{name}`")))]
    return actual.select(*sides[0]), expected.select(*sides[1])


def fingerprint(df: DataFrame) -> DataFrame:
    """One row (n, high, low): the number of rows and the sums of their 128-bit digests.

    Equal multisets of rows of the same types have equal fingerprints, in any order of rows; others
    have them with a chance of about 2 to the -120th. One aggregation, combined where rows lie.
    """
    # adding zero makes -0.0 and 0.0, which are equal, be written alike
    columns = [
        (F.col(f"`{f.name}`") + F.lit(0.0) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")).alias(f"c{i}")
        for i, f in enumerate(df.schema.fields)
    ]
    digest = F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))

    def half(begin: int) -> Column:
        return F.sum(F.conv(F.substring(digest, begin, 16), 16, 10).cast("decimal(20,0)"))

    return df.agg(F.count(F.lit(1)).alias("n"), half(1).alias("high"), half(17).alias("low"))


def row_differences(
    actual: DataFrame, expected: DataFrame, digits: int | None = None
) -> DataFrame:
    """Rows whose number differs, with ``surplus`` = times in actual minus times in expected.

    Columns of differing number types are compared exactly: whole numbers and decimals as decimals
    wide enough for both (split in two, ``name`` and ``name__1``, where 38 digits are too few), a
    double with these by what it is written as. With ``digits`` floating numbers, and decimals that
    meet floating ones, are rounded to so many places on both sides. Each side shrinks to its
    distinct rows and their number before the two meet: equal rows collapse before their one
    shuffle, the union keeps that layout for the last aggregation, and a sort at the end of an
    answer is dropped by the optimizer.
    """
    typed = _typed(actual, expected, digits)
    if typed is None:
        raise ValueError(f"columns differ: {actual.dtypes} and {expected.dtypes}")
    columns = [f"`{c}`" for c in typed[0].columns]
    times = F.count(F.lit(1))
    found = typed[0].groupBy(*columns).agg(times.alias("__times"))
    wanted = typed[1].groupBy(*columns).agg((-times).alias("__times"))
    surplus = found.unionAll(wanted).groupBy(*columns).agg(F.sum("__times").alias("surplus"))
    return surplus.where(F.col("surplus") != 0)


def _counted(actual: DataFrame, expected: DataFrame, digits: int | None) -> DataFrame:
    """Missing and extra rows, by meeting all rows."""
    rows = F.count(F.lit(1))
    if _typed(actual, expected, digits) is None:
        none = F.lit(0).cast("long")
        missing = expected.agg(rows.alias("missing_rows"), none.alias("extra_rows"))
        extra = actual.agg(none.alias("missing_rows"), rows.alias("extra_rows"))
        both = missing.unionByName(extra).agg(
            F.sum("missing_rows").alias("missing_rows"), F.sum("extra_rows").alias("extra_rows")
        )
        return both.withColumn("matches", F.lit(False))
    surplus = F.col("surplus")
    counted = row_differences(actual, expected, digits).agg(
        F.coalesce(F.sum(F.greatest(-surplus, F.lit(0))), F.lit(0)).alias("missing_rows"),
        F.coalesce(F.sum(F.greatest(surplus, F.lit(0))), F.lit(0)).alias("extra_rows"),
    )
    return counted.withColumn(
        "matches", (F.col("missing_rows") == 0) & (F.col("extra_rows") == 0)
    )


def compared(
    pairs: Mapping[str, tuple[DataFrame, DataFrame]], digits: int | None = None
) -> DataFrame:
    """One row for each pair (actual, expected): name, missing_rows, extra_rows, matches.

    The fingerprints of all pairs are taken in one job, here and now; two lines for each pair come
    to the driver. Pairs with equal ones are done, only the others compare their rows, lazily.
    """
    typed = {name: _typed(*pair, digits) for name, pair in pairs.items()}
    marks = [
        fingerprint(df).select(F.lit(name).alias("name"), "n", "high", "low")
        for name, both in typed.items()
        if both
        for df in both
    ]
    seen: dict[str, list] = {}
    for row in reduce(DataFrame.unionAll, marks).collect() if marks else ():
        seen.setdefault(row["name"], []).append(row[1:])
    results = []
    for name, pair in pairs.items():
        if typed[name] and seen[name][0] == seen[name][1]:
            zero = F.lit(0).cast("long")
            spark = pair[0].sparkSession
            counts = spark.range(1).select(zero.alias("missing_rows"), zero.alias("extra_rows"), F.lit(True).alias("matches"))
        else:
            counts = _counted(*pair, digits)
        results.append(counts.select(F.lit(name).alias("name"), "missing_rows", "extra_rows", "matches"))
    return reduce(DataFrame.unionAll, results)


def difference_counts(
    actual: DataFrame, expected: DataFrame, digits: int | None = None
) -> DataFrame:
    """One row: ``missing_rows`` (expected, not found), ``extra_rows`` and ``matches``.

    An answer with other columns, or with a column whose type can't be compared, doesn't match:
    all expected rows are missing and all given ones extra. Takes the fingerprints at once.
    """
    return compared({"": (actual, expected)}, digits).drop("name")


@dataclass(frozen=True)
class Comparison:
    same_schema: bool
    missing_rows: int
    extra_rows: int

    @property
    def matches(self) -> bool:
        return self.same_schema and not (self.missing_rows or self.extra_rows)


def compare(actual: DataFrame, expected: DataFrame) -> Comparison:
    """Compare names, types and rows; row and column order do not count."""
    types = [{f.name: f.dataType for f in df.schema.fields} for df in (actual, expected)]
    if _typed(actual, expected, None) is None:
        return Comparison(False, expected.count(), actual.count())
    counts = difference_counts(actual, expected).first()
    return Comparison(types[0] == types[1], counts["missing_rows"], counts["extra_rows"])
