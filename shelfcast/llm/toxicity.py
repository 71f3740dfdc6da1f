"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

``P(grade <= k) = sigmoid(threshold_k - weights . features)``: one weight for each feature, shared
by all thresholds, which are kept in order. A document's result is its expected grade.

Features are a word (A-Z in lower case, punctuation stripped) and its first four, five and six
code points, so that unseen endings of a telling stem count. A feature is there or not, however often.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import STEP_BYTES, column, pieces, text_bytes, written

#: The fit looks at this many labelled documents at most, those with the least hashes of their key.
MOST_LABELLED = 20_000
#: Features that the model may use at most, those that tell the classes apart best; documents that
#: must hold one; and the log-likelihood that one must gain, which chance rarely gives any of them.
#: Features of clean documents are none of the model's: a long text would collect them.
MOST_FEATURES, LEAST_DOCUMENTS, LEAST_GAIN = 4096, 3, 8.0
GRADES = 3
PENALTY, ROUNDS, RATE = 3e-5, 500, 0.1
PREFIXES = (4, 5, 6)
#: Probability of a grade of 1 or more from which a document counts as toxic.
CHANCE = 0.3
_STRIP = b".,;:!?\"'()[]{}"


def features_of(word: bytes) -> tuple[str, ...]:
    """The features of one word in lower case."""
    word = word.strip(_STRIP)
    if not word:
        return ()
    text = word.decode("utf-8", "replace")
    return (text, *(f"{text[:n]}*" for n in PREFIXES if len(text) > n))


def document_features(text: bytes) -> set[str]:
    found: set[str] = set()
    for word in set(text.lower().split()):
        found.update(features_of(word))
    return found


@dataclass
class SeverityModel:
    """Features with their weights, and the ordered thresholds between grades."""

    weights: dict[str, float]
    thresholds: list[float]

    def expected(self, score: float) -> tuple[float, float]:
        """Expected grade, and the probability of the least toxic grade or more."""
        above = [1.0 / (1.0 + np.exp(np.clip(t - score, -60, 60))) for t in self.thresholds]
        return float(sum(above)), float(above[0])


def fit_ordinal(
    rows: list[np.ndarray], grades: np.ndarray, width: int, n_grades: int
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that maximise the penalised likelihood (full-batch Adam).

    ``rows`` has each document's feature numbers. Without two different grades, or without
    features, weights are zero and the thresholds follow the shares of the grades.
    """
    sizes = np.array([len(r) for r in rows], np.int64)
    at = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), sizes)
    steps = n_grades - 1
    shares = (np.bincount(grades, minlength=n_grades).cumsum()[:-1] + 0.5) / (len(grades) + 1)
    start = np.log(shares / (1 - shares))
    gaps = np.log(np.maximum(np.diff(start), 0.05))
    state = np.concatenate([np.zeros(width), start[:1], gaps])
    if not len(at) or len(np.unique(grades)) < 2:
        return np.zeros(width), start
    first, second = np.zeros_like(state), np.zeros_like(state)
    for round_ in range(1, ROUNDS + 1):
        weights, cuts = state[:width], _thresholds(state[width:])
        score = np.bincount(owner, weights[at], minlength=len(rows))
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        with np.errstate(over="ignore"):
            upper = 1 / (1 + np.exp(score - edges[grades + 1]))
            lower = 1 / (1 + np.exp(score - edges[grades]))
        chance = np.maximum(upper - lower, 1e-12)
        up, low = upper * (1 - upper) / chance, lower * (1 - lower) / chance
        slope = np.bincount(at, (up - low)[owner], minlength=width) / len(rows)
        by_cut = np.array(
            [(-up[grades == k].sum() + low[grades == k + 1].sum()) / len(rows) for k in range(steps)]
        )
        tail = by_cut[::-1].cumsum()[::-1]
        gradient = np.concatenate(
            [slope + PENALTY * weights, tail[:1], tail[1:] * np.exp(state[width + 1 :])]
        )
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        step = (first / (1 - 0.9**round_)) / (np.sqrt(second / (1 - 0.999**round_)) + 1e-8)
        state = state - RATE * step
    return state[:width], _thresholds(state[width:])


def _thresholds(state: np.ndarray) -> np.ndarray:
    return state[0] + np.concatenate([[0.0], np.cumsum(np.exp(state[1:]))])


def _telling(counts: pd.DataFrame, positive: int, negative: int) -> pd.DataFrame:
    """Counts with a signed measure of how well a feature tells the classes apart."""
    p = (counts["pos"] + 0.5) / (positive + 1)
    q = (counts["neg"] + 0.5) / (negative + 1)
    both = (counts["pos"] + counts["neg"] + 1) / (positive + negative + 2)
    gain = counts["pos"] * np.log(p / both) + counts["neg"] * np.log(q / both)
    return counts.assign(gain=gain, ratio=p / q).sort_values(["gain", "f"], ascending=[False, True])


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    most: int = MOST_LABELLED,
) -> SeverityModel:
    """Fits the model on labelled rows.

    Grades come from ``label`` itself when it has values above 1. A label of 0 and 1 knows no
    degrees: grade 1 is then a toxic document with fewer telling words than the median toxic one,
    grade 2 one with as many or more; telling words are features at least 20 times as
    likely in toxic documents as in others. Labels without a value, and of documents that are not
    there, are left out; repeated labels of a key count once each. Without labels, or with labels
    of one kind only, nothing is told apart and the expected grade follows the labels' shares
    (0 without any).
    """
    wanted = labels.where(column(label).isNotNull() & column(key).isNotNull()).select(
        column(key).alias("key"), column(label).cast("int").alias("label")
    )
    # at most ``most`` rows of two numbers
    sample = F.broadcast(wanted.orderBy(F.xxhash64("key"), "label").limit(most))
    known = docs.select(column(key).alias("key"), text_bytes(text).alias("text")).join(sample, "key")
    known = known.select("text", "label")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [Counter(), Counter()]
        totals = [0, 0]
        for batch in batches:
            for data, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[value > 0].update(document_features(data))
                totals[value > 0] += 1
        names = sorted(set(seen[0]) | set(seen[1]))
        yield pa.record_batch(
            [
                pa.array([*names, ""], pa.string()),
                pa.array([*(seen[1][n] for n in names), totals[1]], pa.int64()),
                pa.array([*(seen[0][n] for n in names), totals[0]], pa.int64()),
            ],
            names=["f", "pos", "neg"],
        )

    counted = known.mapInArrow(count, "f string, pos long, neg long").groupBy("f").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    # read twice below; only features that the model may use are written
    counted = written(
        counted.where(f"f = '' or pos > 0 and pos + neg >= {LEAST_DOCUMENTS}"), "features"
    )
    total = counted.where("f = ''").first()
    if total is None or not total["pos"] or not total["neg"]:
        share = 0 if total is None or not total["pos"] else 1
        return SeverityModel({}, [30.0 if not share else -30.0] * (GRADES - 1))
    p, n = F.lit(float(total["pos"])), F.lit(float(total["neg"]))
    # the same measure in Spark, so that only the best features reach the driver
    pp, qq = (F.col("pos") + 0.5) / (p + 1), (F.col("neg") + 0.5) / (n + 1)
    both = (F.col("pos") + F.col("neg") + 1) / (p + n + 2)
    gain = F.col("pos") * F.log(pp / both) + F.col("neg") * F.log(qq / both)
    best = (
        counted.where((F.col("f") != "") & (F.col("pos") + F.col("neg") >= LEAST_DOCUMENTS))
        .where((gain >= LEAST_GAIN) & (pp > qq)).orderBy(gain.desc(), "f").limit(MOST_FEATURES).toPandas()
    )
    best = _telling(best, total["pos"], total["neg"])
    names = best["f"].tolist()
    numbers = {f: i for i, f in enumerate(names)}
    sharp = set(best.index[(best["ratio"] >= 20) & (best["pos"] >= LEAST_DOCUMENTS)])
    sharp_names = {f for i, f in zip(best.index, names, strict=True) if i in sharp and not f.endswith("*")}
    stems = {f for i, f in zip(best.index, names, strict=True) if i in sharp and f.endswith("*")}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, marks = [], []
            for data in batch.column(0).to_pylist():
                words = [features_of(w) for w in data.lower().split()]
                rows.append(sorted({numbers[f] for w in set(words) for f in w if f in numbers}))
                marks.append(sum(bool(w) and (w[0] in sharp_names or not stems.isdisjoint(w)) for w in words))
            yield pa.record_batch(
                [batch.column(1), pa.array(rows, pa.list_(pa.int32())), pa.array(marks, pa.int64())],
                names=["label", "row", "marks"],
            )

    fitted = known.mapInArrow(vectors, "label int, row array<int>, marks long").toPandas()
    label_ = fitted["label"].to_numpy()
    if label_.max() > 1:
        grades, n_grades = np.maximum(label_, 0), int(label_.max()) + 1
    else:
        marks = fitted["marks"].to_numpy()
        middle = np.median(marks[label_ > 0])
        grades, n_grades = np.where(label_ > 0, 1 + (marks >= middle), 0), GRADES
    weights, cuts = fit_ordinal([np.asarray(r) for r in fitted["row"]], grades, len(names), n_grades)
    return SeverityModel(
        {f: float(w) for f, w in zip(names, weights, strict=True) if w}, [float(c) for c in cuts]
    )


def score_toxicity(docs: DataFrame, model: SeverityModel, text: str = "text", most_cached: int = 300_000) -> DataFrame:
    """Every row of ``docs`` with ``expected_severity``, ``severity`` (the nearest grade) and ``toxic``.

    ``toxic``: a grade of 1 or more has a probability of ``CHANCE`` or more. A null or empty text has no features.
    Columns of these names are replaced, others stay. Memory: the model and a bounded cache of words.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))
    others = [c for c in docs.columns if c.lower() not in ("expected_severity", "severity", "toxic")]
    row = F.struct(F.lit(1).alias("x"), *[column(c).alias(f"c{i}") for i, c in enumerate(others)])
    packed = docs.select(text_bytes(text).alias("text"), row.alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = SeverityModel(*shared.value)
        weights = fitted.weights
        words: dict[bytes, tuple[str, ...]] = {}
        for batch in batches:
            for piece in pieces(batch, 0, STEP_BYTES):
                found = []
                for data in piece.column(0).to_pylist():
                    mine: set[str] = set()
                    for word in set(data.lower().split()):
                        known = words.get(word)
                        if known is None:
                            if len(words) >= most_cached:
                                words.clear()
                            known = tuple(f for f in features_of(word) if f in weights)
                            words[word] = known
                        if known:
                            mine.update(known)
                    found.append(fitted.expected(sum(weights[f] for f in sorted(mine))))
                severity = np.array([f[0] for f in found], float)
                chance = np.array([f[1] for f in found], float)
                yield pa.record_batch(
                    [
                        piece.column(1), pa.array(severity),
                        pa.array(np.rint(severity).astype(np.int32)), pa.array(chance >= CHANCE),
                    ],
                    names=["row", "expected_severity", "severity", "toxic"],
                )

    kind = packed.schema["row"].dataType.simpleString()
    done = packed.mapInArrow(run, f"row {kind}, expected_severity double, severity int, toxic boolean")
    return done.select(
        *[F.col("row").getField(f"c{i}").alias(c) for i, c in enumerate(others)],
        "expected_severity", "severity", "toxic",
    )
