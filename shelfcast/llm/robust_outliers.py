"""Quality rules by robust outlier detection: minimum covariance determinant per language and source.

Each document gives a few counts; transformed, they are a vector. A group's centre and scatter come
from the half (``CORE``) of its documents that is most compact. The concentration steps run on all
documents of all groups at once: a step sorts documents into bins of their present distance and
keeps, for each group and bin, count, sums and products. The bins nearest the centre that hold the
core give the next estimate, the last of them by the share of its weight that the core still needs.
So a step is one aggregation that combines before its shuffle, and a group with a third of all
documents is no bottleneck.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import STEP_BYTES, column, mixed, pieces, text_bytes, written
from .shingles import word_hashes

#: Share of a group's documents that its estimate rests on: of n in p dimensions, (n + p + 1) / 2.
CORE = 0.5
STEPS = 6
#: A group with fewer documents uses its language's estimate, a small language that of all.
LEAST_GROUP = 50
#: Documents beyond this quantile of the squared distances of normal vectors are rejected.
QUANTILE = 0.99999
#: Least standard deviation of each transformed statistic, for those that hardly vary.
FLOORS = (0.5, 0.1, 0.1, 0.15, 0.15)
DIMENSIONS = len(FLOORS)
#: Bins of the logarithm of the squared distance: this many for each factor of e, from e**-8.
_PER_E, _LOWEST, _BINS = 12, -8, 300

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0
    seen: set[bytes] = set()
    found = 0
    for line in lines:
        if line in seen:
            found += bool(line.strip())
        seen.add(line)
    return found


def text_counts(texts: list[bytes]) -> list[np.ndarray]:
    """For each text its number of words, code points in words, symbols, repeated lines, words in
    3-word windows that the text holds twice or more, and lines."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    starts = np.cumsum([0, *[len(t) + 1 for t in texts]])

    def per_text(flags: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return np.diff(run[starts])

    chars = per_text(~_BLANK[data] & ((data & 0xC0) != 0x80))
    symbols = per_text(_SYMBOL[data])
    lines = per_text(data == 10) + 1
    words, counts = word_hashes(texts, lower=False)
    owner = np.repeat(np.arange(len(texts)), counts)
    covered = np.zeros(len(words), bool)
    if len(words) > 2:
        windows = mixed(
            words[:-2] * np.uint64(0x9E3779B97F4A7C15) + mixed(words[1:-1])
            + mixed(words[2:] + np.uint64(1)) * np.uint64(0xA0761D6478BD642F)
            + mixed(owner[:-2].astype(np.uint64) + np.uint64(7))
        )
        inside = np.flatnonzero(owner[:-2] == owner[2:])  # no window spans two texts
        _, which, times = np.unique(windows[inside], return_inverse=True, return_counts=True)
        twice = inside[times[which] > 1]
        for k in range(3):
            covered[twice + k] = True
    repeats = np.bincount(owner[covered], minlength=len(texts))
    dup = np.array([repeated_lines(t) for t in texts], np.int64)
    return [counts.astype(np.int64), chars, symbols, dup, repeats.astype(np.int64), lines]


def document_counts(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """The columns ``keep`` of every row and the counts of its whole text."""
    kept = F.struct(F.lit(1).alias("x"), *[column(c).alias(f"c{i}") for i, c in enumerate(keep)])
    packed = docs.select(text_bytes(text).alias("text"), kept.alias("kept"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 0, STEP_BYTES // 2):
                found = text_counts(piece.column(0).to_pylist())
                yield pa.record_batch(
                    [piece.column(1), *map(pa.array, found)], names=["kept", *COUNTS]
                )

    kind = packed.schema["kept"].dataType.simpleString()
    done = packed.mapInArrow(run, ", ".join([f"kept {kind}", *(f"{c} long" for c in COUNTS)]))
    return done.select(*[F.col("kept").getField(f"c{i}").alias(f"k{i}") for i in range(len(keep))], *COUNTS)


def vector() -> Column:
    """The transformed statistics: length, word length, symbols, repeated lines, repeated words."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return F.array(
        F.log1p("n_words"),
        F.log((F.col("word_chars") + 1) / words),
        F.log1p(10 * F.col("n_symbols") / words),
        F.col("n_dup_lines") / F.col("n_lines"),
        F.col("n_repeat_words") / words,
    )


def chi_square_quantile(p: float, k: int) -> float:
    """By bisection of the distribution function."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, k) < p else (low, middle)
    return high


def chi_square(x: float, k: int) -> float:
    """Distribution function with ``k`` degrees of freedom, by its series."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= x / n
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def consistency(core: float, k: int) -> float:
    """Factor that makes the core's scatter that of all, for normal vectors."""
    return core / chi_square(chi_square_quantile(core, k), k + 2)


def _distance() -> Column:
    """Squared distance of ``x`` from ``centre``, with ``inverse`` row by row."""
    away = [F.get("x", F.lit(i)) - F.get("centre", F.lit(i)) for i in range(DIMENSIONS)]
    terms = [
        away[i] * away[j] * F.get("inverse", F.lit(i * DIMENSIONS + j)) * (1 if i == j else 2)
        for i in range(DIMENSIONS)
        for j in range(i, DIMENSIONS)
    ]
    return F.greatest(sum(terms[1:], terms[0]), F.lit(0.0))


_PAIRS = [(i, j) for i in range(DIMENSIONS) for j in range(i, DIMENSIONS)]
_SUMS = [f"s{i}" for i in range(DIMENSIONS)]
_PRODUCTS = [f"p{i}_{j}" for i, j in _PAIRS]
_ESTIMATE = "grp string, n long, centre array<double>, inverse array<double>, logdet double"


def _moments(rows: DataFrame, *by: str) -> DataFrame:
    x = [F.get("x", F.lit(i)) for i in range(DIMENSIONS)]
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(x[i]).alias(_SUMS[i]) for i in range(DIMENSIONS)],
        *[F.sum(x[i] * x[j]).alias(name) for (i, j), name in zip(_PAIRS, _PRODUCTS, strict=True)],
    )


def _estimate(group: str, total: int, part: pd.DataFrame, factor: float) -> dict:
    n = part["n"].sum()
    centre = part[_SUMS].sum().to_numpy(float) / n
    scatter = np.zeros((DIMENSIONS, DIMENSIONS))
    for (i, j), name in zip(_PAIRS, _PRODUCTS, strict=True):
        scatter[i, j] = scatter[j, i] = part[name].sum() / n - centre[i] * centre[j]
    scatter = factor * scatter + np.diag(np.square(FLOORS))
    return {
        "grp": group, "n": int(total), "centre": centre.tolist(),
        "inverse": np.linalg.inv(scatter).ravel().tolist(), "logdet": float(np.linalg.slogdet(scatter)[1]),
    }


def estimates(rows: DataFrame) -> DataFrame:
    """Centre and inverse scatter of each group of ``(grp, x)``; a group has few hundred bins."""
    x = [F.get("x", F.lit(i)) for i in range(DIMENSIONS)]
    # written, so that the size of this one line per group is known before the rows would be shuffled
    middles = written(
        rows.groupBy("grp").agg(
            F.count(F.lit(1)).alias("n"),
            F.array(*[F.percentile_approx(v, 0.5, 10000) for v in x]).alias("centre"),
        ),
        "middles",
    )
    away = [F.abs(x[i] - F.get("centre", F.lit(i))) for i in range(DIMENSIONS)]
    spread = rows.join(middles, "grp").groupBy("grp").agg(
        F.first("n").alias("n"), F.first("centre").alias("centre"),
        F.array(*[F.percentile_approx(a, 0.5, 10000) for a in away]).alias("mad"),
    )
    inverse = [
        1 / (F.pow(1.4826 * F.get("mad", F.lit(i)), F.lit(2)) + FLOORS[i] ** 2) if i == j else F.lit(0.0)
        for i in range(DIMENSIONS)
        for j in range(DIMENSIONS)
    ]
    found = written(
        spread.select("grp", "n", "centre", F.array(*inverse).alias("inverse"), F.lit(None).cast("double").alias("logdet")),
        "mcd_start",
    )

    def concentrate(key: tuple, bins: pd.DataFrame) -> pd.DataFrame:
        bins = bins.sort_values("bin")
        total = bins["n"].sum()
        core = min(total, CORE * (total + DIMENSIONS + 1))
        share = ((core - (bins["n"].cumsum() - bins["n"])) / bins["n"]).clip(0, 1)
        inner = bins[["n", *_SUMS, *_PRODUCTS]].mul(share, axis=0)
        return pd.DataFrame([_estimate(key[0], total, inner, consistency(core / total, DIMENSIONS))])

    def reweigh(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([_estimate(key[0], part["total"].iloc[0], part, 1.0)])

    bin_ = F.floor(F.log(_distance() + math.exp(_LOWEST)) * _PER_E).cast("int")
    before = None
    for _ in range(STEPS):
        binned = rows.join(found, "grp").withColumn("bin", F.least(bin_, F.lit(_BINS)))
        step = _moments(binned.select("grp", "bin", "x"), "grp", "bin")
        found = written(step.groupBy("grp").applyInPandas(concentrate, _ESTIMATE), "mcd_step")
        now = found.agg(F.sum("logdet")).first()[0]
        if before is not None and now is not None and abs(now - before) < 1e-6 * abs(now):
            break
        before = now
    # one step of weights: all that lie within the usual limit count alike
    usual = chi_square_quantile(0.975, DIMENSIONS)
    near = rows.join(found.withColumnRenamed("n", "total"), "grp").where(_distance() <= usual)
    last = _moments(near, "grp", "total").groupBy("grp").applyInPandas(reweigh, _ESTIMATE)
    return written(last, "mcd")


def robust_quality(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
    quantile: float = QUANTILE,
) -> DataFrame:
    """Counts and verdict of every row: key, the counts, base_failed, distance, kept.

    ``base_failed``: fewer than 50 words, or more than half of them in repeated 3-word windows.
    ``distance``: squared Mahalanobis distance of the row's vector from its group of language and
    source, by the group's robust estimate from rows that pass the base rules; null where no
    estimate exists. ``kept``: the base rules are passed and the distance is not beyond
    ``quantile``. A null text has no words; null languages and sources are groups of their own.
    Equal rows get equal results. An empty table gives an empty result.
    """
    stats = document_counts(docs, [key, lang, source], text).select(
        F.col("k0").alias("key"),
        F.coalesce(F.concat(F.lit("="), F.col("k1").cast("string")), F.lit("-")).alias("lang"),
        F.coalesce(F.concat(F.lit("="), F.col("k2").cast("string")), F.lit("-")).alias("source"),
        *COUNTS,
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = written(stats.withColumn("base_failed", failed).withColumn("x", vector()), "stats")
    fine, wide = F.concat_ws("\u0001", "lang", "source"), F.col("lang")
    good = stats.where(~F.col("base_failed"))
    rows = good.select("x", F.explode(F.array(fine, wide, F.lit(""))).alias("grp"))
    found = estimates(rows).where((F.col("n") >= LEAST_GROUP) | (F.col("grp") == ""))
    chosen = stats.withColumn("f", fine).withColumn("w", wide)
    for name, at in (("e1", F.col("f")), ("e2", F.col("w")), ("e3", F.lit(""))):
        # one line for each group of language and source, whatever the number of documents
        one = found.select(F.col("grp").alias("g"), F.struct("centre", "inverse").alias(name))
        chosen = chosen.join(one, at == F.col("g"), "left").drop("g")
    best = F.coalesce("e1", "e2", "e3")
    judged = chosen.withColumn("centre", best["centre"]).withColumn("inverse", best["inverse"])
    limit = chi_square_quantile(quantile, DIMENSIONS)
    far = F.coalesce(F.col("distance") > limit, F.lit(False))
    return judged.withColumn("distance", _distance()).select(
        F.col("key").alias(key), *COUNTS, "base_failed", "distance",
        (~F.col("base_failed") & ~far).alias("kept"),
    )
