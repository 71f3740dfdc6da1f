"""Mixing sources to target weights, dealt to output shards by a hypergeometric splitting tree.

A source's share of the mix is met by whole passes over its documents and a part of one more. A
document's hash places it in one of 1,024 blocks of its source, so the order of blocks is a random
permutation. The part takes blocks in that order as long as they fit; one that doesn't fit is cut
further by more digits of the hash (three levels, each one aggregation over fixed-size cells), and
the gap that is left gets the documents that fill it best. All drawn blocks form exact quotas per
source, which a splitting tree deals to the shards: a node's two halves get a draw from the
multivariate hypergeometric distribution. Each source's permuted blocks are then handed out in
order, disjointly, and a shard is shuffled locally.

Totals of each source and of up to 1,024 of its cells at each level come to the driver, and the cells
taken are sent to all tasks; with very many small sources that nears one entry for each document.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import column, n_words, whole_text, written

WEIGHTS, SHARE, CAP = (5.0, 2.0, 1.0), 1.5, 2.0
SHARDS, SEED = 64, 20250306
_DIGIT = 10
_CELLS = 1 << _DIGIT
#: Rounds in which the document that best fills a source's gap is added.
FILL_ROUNDS = 4


def targets(sizes: Sequence[int], weights: Sequence[float], share: float, cap: float) -> list[float]:
    """``share`` of all sizes by weight; none above ``cap`` times its size, the excess reshared."""
    left, open_, out = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if unit * weights[i] > cap * sizes[i]}
        if not over:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = float(cap * sizes[i])
        left -= sum(out[i] for i in over)
        open_ -= over
    return out


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Deals ``quotas`` (blocks per source) to shards of near-equal totals: a (source, shard) table.

    Recursively, the left half of a node's shards draws its blocks without replacement from the
    node's, by the multivariate hypergeometric distribution; column sums give the quotas back.
    """
    table = np.zeros((len(quotas), shards), np.int64)
    total = int(quotas.sum())
    room = [total // shards + (k < total % shards) for k in range(shards)]

    def node(first: int, last: int, counts: np.ndarray) -> None:
        if last - first == 1:
            table[:, first] = counts
            return
        middle = (first + last) // 2
        random = np.random.default_rng([seed, first, last])
        taken = random.multivariate_hypergeometric(counts, sum(room[first:middle]), method="marginals")
        node(first, middle, taken)
        node(middle, last, counts - taken)

    if len(quotas):
        node(0, shards, np.asarray(quotas, np.int64))
    return table


@dataclass
class _Plan:
    key: str
    source: str | None
    words: int
    target: float
    passes: int
    left: float
    #: Of each level the cells that the part takes whole, and the digit of the one that is cut.
    taken: list[list[int]] = field(default_factory=list)
    cell: list[int] = field(default_factory=list)
    extra: list[int] = field(default_factory=list)
    cuts: list[int] = field(default_factory=list)


def _source_key(source: str) -> Column:
    named = F.concat(F.lit("="), column(source).cast("string"))
    return F.coalesce(named, F.lit("-"))


def _digit(at: Column, level: int) -> Column:
    shifted = F.shiftrightunsigned(at, 64 - _DIGIT * (level + 1))
    return shifted.bitwiseAND(_CELLS - 1)


def _placed(docs: DataFrame, key: str, text: str, source: str, seed: int) -> DataFrame:
    return docs.select(
        F.struct(*[column(c) for c in docs.columns]).alias("doc"),
        _source_key(source).alias("skey"), n_words(text).alias("size"),
        F.xxhash64(F.lit(seed), column(key), whole_text(text)).alias("at"),
    )


def _in_cell(spark: SparkSession, sizes: DataFrame, plans: list[_Plan]) -> DataFrame:
    """The documents of each source's cell so far, of sources that still need a part of a pass."""
    rows = [(p.key, *p.cell) for p in plans]
    names = [f"c{i}" for i in range(len(plans[0].cell))]
    cells = spark.createDataFrame(rows, ", ".join(["skey string", *(f"{n} long" for n in names)]))
    inside = sizes.join(F.broadcast(cells), "skey")
    for level, name in enumerate(names):
        inside = inside.where(_digit(F.col("at"), level) == F.col(name))
    return inside


def plan_mix(
    sizes: DataFrame, weights: Sequence[float], share: float, cap: float, shards: int, seed: int
) -> list[_Plan]:
    """What each source gives, from ``(skey, source, size, at)`` of every document."""
    spark = sizes.sparkSession
    totals = sizes.groupBy("skey", "source").agg(F.sum("size").alias("words")).collect()
    totals.sort(key=lambda r: (r["source"] is None, r["source"]))
    goal = targets(
        [r["words"] for r in totals], [weights[i % len(weights)] for i in range(len(totals))], share, cap
    )
    plans = []
    for row, target in zip(totals, goal, strict=True):
        passes = int(target // row["words"]) if row["words"] else 0
        plans.append(
            _Plan(row["skey"], row["source"], row["words"], target, passes, target - passes * row["words"])
        )
    parts = [p for p in plans if p.left > 0 and p.words]
    for level in range(3):
        if not parts:
            break
        cells = (
            _in_cell(spark, sizes, parts).groupBy("skey", _digit(F.col("at"), level).alias("cell"))
            .agg(F.sum("size").alias("words")).collect()
        )
        by_key: dict[str, list] = {}
        for row in cells:
            by_key.setdefault(row["skey"], []).append((row["cell"], row["words"]))
        for plan in parts:
            fits, skipped = [], []
            for cell, words in sorted(by_key.get(plan.key, [])):
                if words <= plan.left:
                    fits.append(cell)
                    plan.left -= words
                else:
                    skipped.append((words, cell))
            plan.taken.append(fits)
            plan.cell.append(min(skipped)[1] if skipped else -1)
    for round_ in range(FILL_ROUNDS + 1 if parts else 0):
        closing = round_ == FILL_ROUNDS  # a document that goes beyond the target, but less far from it
        gaps = [(p.key, p.left, p.taken, p.cell, p.extra) for p in parts if p.left >= 1]
        if not gaps:
            break
        table = spark.createDataFrame(
            gaps, "skey string, room double, taken array<array<long>>, cell array<long>, extra array<long>"
        )
        free = sizes.join(F.broadcast(table), "skey").where(
            (F.col("size") > 0) & ~_taken_part(F.col("at"))
            & (F.col("size") < 2 * F.col("room") if closing else F.col("size") <= F.col("room"))
        )
        pick = F.min if closing else F.max
        best = free.groupBy("skey").agg(pick(F.struct("size", "at")).alias("best")).collect()
        found = {r["skey"]: r["best"] for r in best}
        for plan in parts:
            if plan.key in found:
                plan.left -= found[plan.key]["size"]
                plan.extra.append(found[plan.key]["at"])
    blocks = np.array([p.passes * _CELLS + (len(p.taken[0]) + 1 if p.taken else 0) for p in plans], np.int64)
    dealt = split_quotas(blocks, shards, seed)
    for plan, row in zip(plans, dealt, strict=True):
        plan.cuts = np.cumsum(row).tolist()
    return plans


def _taken_part(at: Column) -> Column:
    """Whether the part of a pass holds a document: in a whole cell, or picked to fill the gap."""
    cell, digit = F.col("cell"), [_digit(at, i) for i in range(3)]
    taken = [F.coalesce(F.array_contains(F.get("taken", F.lit(i)), digit[i]), F.lit(False)) for i in range(3)]
    same = [F.coalesce(digit[i] == F.get(cell, F.lit(i)), F.lit(False)) for i in range(2)]
    part = taken[0] | (same[0] & (taken[1] | (same[1] & taken[2])))
    return part | F.array_contains("extra", at)


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    shards: int = SHARDS,
    seed: int = SEED,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """``(doc, size, source_size, target, draws)`` of every row; ``doc`` holds its columns.

    Size: words of the text, 0 for a null one. Sources by code point, null last, take the weights
    in turn and share ``share`` times all words; a target stops at ``cap`` times its source's
    words, the excess is reshared by weight. ``draws`` has an entry ``(pass, shard, place)`` for
    each time that the mix takes the document. The words taken differ from the target by
    less than half of the smallest document left out, as a rule; a document is taken no more often than ``cap`` rounded up. Reruns
    agree: everything follows from seed, key, text and the words of each source. Rows equal in key
    and text share a fate. A document without words is drawn like any other and adds nothing. An
    empty table gives an empty result. The driver holds one line per source, with its taken cells.
    """
    spark = docs.sparkSession
    rows = _placed(docs, key, text, source, seed)
    sizes = written(
        rows.select("skey", F.col("doc").getField(source).cast("string").alias("source"), "size", "at"),
        "sizes",
    )
    plans = plan_mix(sizes, weights, share, cap, shards, seed)
    odd = lambda p, n: (hash_of(p.key, seed, n) | 1) % _CELLS
    table = spark.createDataFrame(
        [
            (
                p.key, p.words, p.target, p.passes, p.taken, p.cell, p.extra, p.cuts,
                [odd(p, n) for n in range(p.passes)],
            )
            for p in plans
        ],
        "skey string, source_size long, target double, passes int, taken array<array<long>>, cell array<long>, "
        "extra array<long>, cuts array<long>, odd array<long>",
    )
    joined = rows.join(F.broadcast(table), "skey", "left")
    block = _digit(F.col("at"), 0)

    # places come first: what stands inside the search among the cuts is computed anew for each of them
    places = F.transform("odd", lambda a, n: n * _CELLS + (block * a) % _CELLS)
    among = F.array_position(F.get("taken", F.lit(0)), block)
    place = F.when(among > 0, among - 1).otherwise(F.size(F.get("taken", F.lit(0))))
    last = F.when(_taken_part(F.col("at")), F.array(F.col("passes") * _CELLS + place))

    def draw(place: Column, number: Column) -> Column:
        shard = F.size(F.filter("cuts", lambda c: c <= place))
        order = F.xxhash64(F.lit(seed + 1), F.col("at"), number)
        return F.struct(number.alias("pass"), shard.alias("shard"), order.alias("place"))

    every = F.concat(places, F.coalesce(last, F.array().cast("array<bigint>")))
    return joined.select("doc", "size", "source_size", "target", F.transform(every, draw).alias("draws"))


def hash_of(name: str, seed: int, number: int) -> int:
    return zlib.crc32(f"{seed}/{number}/{name}".encode())


def dealt(mixed: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The mix as rows: each draw of each document, together by shard and shuffled inside it.

    Columns of the documents alone. Shards are ranges of partitions, so a shard larger than a
    partition is spread over several, each in random order.
    """
    # an outer explode: for a plain one Spark computes the draws of each document again, to filter by them
    rows = mixed.select("doc", F.explode_outer("draws").alias("draw")).where("draw is not null")
    return (
        rows.repartitionByRange("draw.shard", "draw.place")
        .sortWithinPartitions("draw.shard", "draw.place")
        .select("doc.*")
    )
