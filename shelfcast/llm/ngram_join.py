"""Exact set-similarity join on word shingles: size-banded tiles and bitmap signatures.

1. Texts with equal shingle sets are one class from the start (a set's 128-bit digest names it).
2. Sets of Jaccard ``t`` or more share an element among the first ``n - ceil(t n) + 1`` of either
   in any fixed order of the elements. The order puts elements that a sample shows to be frequent
   last. The sample decides the order and so the work, never the result.
3. Elements that stand in two sets' leading parts are found by an aggregation; a bitmap of them
   (fixed size) lets a second reading of the texts send only the parts that can matter.
4. For classes, each such element first proposes a few pivots to its sets. Confirmed links build
   components; only sets in differing components are compared further.
5. The sets of an element are banded by size (similar sets lie in the same or in neighbouring
   bands) and cut into tiles of bounded size, two blocks each. A tile compares sizes and parity
   signatures; the bit count bounds the overlap from above. Surviving pairs meet a signature as
   wide as the sets are large, and what is left is intersected exactly as sorted arrays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import column, pieces, small_batches, text_bytes, whole_text, written
from .components import components
from .shingles import differing_bits, parity_bitmap, shingle_sets, wide_bitmap

SHINGLE, PERCENT = 5, 80
#: Bits of a signature, and rows of a block (a tile holds two).
SIGNATURE_BITS, BLOCK_ROWS = 1024, 1024
#: One document in so many is looked at for frequent shingles; how often one must occur there,
#: and how many are put last at most (2 MB to every task).
SAMPLE_ONE_IN, SAMPLE_COUNT, MOST_FREQUENT = 16, 16, 1 << 18
#: Bits of the filters on elements and on sets, as a power of two (16 MB). A fuller filter sends
#: more rows to an exact join and changes no result.
FILTER_BITS = 27
PIVOTS = 3
#: Bytes of text that are hashed at a time; NumPy takes about thirty times as much for them.
_STEP = 250_000


def _texts(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(text_bytes(text).alias("text"))


def _node(elements: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(elements.tobytes())


def lead(elements: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """The elements of which a similar set must have one: by hash, frequent ones last."""
    n = len(elements)
    most = n - -(-percent * n // 100) + 1
    if len(frequent) and n:
        at = np.minimum(np.searchsorted(frequent, elements), len(frequent) - 1)
        often = frequent[at] == elements
        elements = np.concatenate([elements[~often], elements[often]])
    return elements[:most] if n else elements


def members_of(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """``(key, n_shingles, node)``: node is null where the set is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 0, _STEP):
                sets = shingle_sets(piece.column(0).to_pylist(), width)
                yield pa.record_batch(
                    [
                        piece.column(1), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_node(s) if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=["key", "n_shingles", "node"],
                )

    kind = docs.select(column(key).alias("k")).schema["k"].dataType.simpleString()
    return docs.select(text_bytes(text).alias("text"), column(key).alias("key")).mapInArrow(
        run, f"key {kind}, n_shingles long, node binary"
    )


def _frequent(docs: DataFrame, key: str, text: str, width: int) -> np.ndarray:
    """Sorted hashes of the most frequent shingles of a sample, ``MOST_FREQUENT`` at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 0, _STEP):
                found = [np.zeros(0, np.uint64), *shingle_sets(piece.column(0).to_pylist(), width)]
                got, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.record_batch(
                    [pa.array(got.view(np.int64)), pa.array(n.astype(np.int64))], names=["e", "n"]
                )

    some = docs.where(F.pmod(F.xxhash64(column(key)), F.lit(SAMPLE_ONE_IN)) == 0)
    top = (
        _texts(some, text).mapInArrow(run, "e long, n long")
        .groupBy("e").agg(F.sum("n").alias("n")).where(F.col("n") >= SAMPLE_COUNT)
        .orderBy(F.desc("n"), "e").limit(MOST_FREQUENT).select("e")
    )
    with small_batches(docs.sparkSession):
        top = top.toPandas()["e"]
    return np.sort(top.to_numpy(np.int64).view(np.uint64))


def _bitmap_of(hashes: DataFrame, name: str, bits: int = FILTER_BITS) -> np.ndarray:
    """One bit for each value of a long column, at its low ``bits`` bits: a fixed-size filter."""
    at = F.col(name).bitwiseAND((1 << bits) - 1)
    chunks = (
        hashes.select(at.alias("at"))
        .groupBy(F.shiftright("at", 15).alias("chunk"))
        .agg(F.expr("bitmap_construct_agg(at & 32767)").alias("bits"))
        .collect()
    )
    whole = np.zeros(1 << (bits - 3), np.uint8)
    for row in chunks:
        whole[row["chunk"] << 12 : (row["chunk"] + 1) << 12] = np.frombuffer(row["bits"], np.uint8)
    return whole


def _in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _lead_rows(docs: DataFrame, text: str, width: int, percent: int, frequent, wanted=None) -> DataFrame:
    """``(e, node)``: the leading elements of each distinct set of a step; with ``wanted`` those
    that its filter holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, bitmap = frequent.value, None if wanted is None else wanted.value
        for batch in batches:
            for piece in pieces(batch, 0, _STEP):
                sets = {_node(s): s for s in shingle_sets(piece.column(0).to_pylist(), width) if len(s)}
                heads = [lead(s, often, percent) for s in sets.values()]
                if bitmap is not None:
                    heads = [h[_in_bitmap(bitmap, h)] for h in heads]
                flat = np.concatenate([np.zeros(0, np.uint64), *heads])
                which = np.repeat(np.arange(len(heads)), [len(h) for h in heads])
                nodes = pa.array(list(sets), pa.binary()).take(pa.array(which))
                yield pa.record_batch([pa.array(flat.view(np.int64)), nodes], names=["e", "node"])

    return _texts(docs, text).mapInArrow(run, "e long, node binary")


def _node_bits(node: str) -> Column:
    return F.conv(F.hex(F.substring(node, 1, 7)), 16, 10).cast("long")


def _sets(docs: DataFrame, text: str, width: int, nodes: DataFrame, arrays: bool) -> DataFrame:
    """``(node, n, data, wide)`` of the given nodes, from the texts and written: the sorted array and
    a wide signature, or the signature of a tile and nothing."""
    wanted = docs.sparkSession.sparkContext.broadcast(
        _bitmap_of(nodes.select(_node_bits("node").alias("h")), "h")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = wanted.value
        for batch in batches:
            for piece in pieces(batch, 0, _STEP):
                found = {}
                for s in shingle_sets(piece.column(0).to_pylist(), width):
                    if len(s) and (node := _node(s)) not in found:
                        found[node] = s
                names = list(found)
                heads = np.array([int.from_bytes(n[:7], "big") for n in names], np.uint64)
                keep = [n for n, ok in zip(names, _in_bitmap(bitmap, heads), strict=True) if ok]
                data = [
                    (found[n] if arrays else parity_bitmap(found[n], SIGNATURE_BITS)).tobytes()
                    for n in keep
                ]
                yield pa.record_batch(
                    [
                        pa.array(keep, pa.binary()),
                        pa.array([len(found[n]) for n in keep], pa.int64()),
                        pa.array(data, pa.binary()),
                        pa.array([wide_bitmap(found[n]).tobytes() if arrays else b"" for n in keep], pa.binary()),
                    ],
                    names=["node", "n", "data", "wide"],
                )

    rows = _texts(docs, text).mapInArrow(run, "node binary, n long, data binary, wide binary")
    exact = rows.join(nodes.select("node").distinct(), "node", "left_semi")
    found = exact.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "data", "wide")])
    found = written(found, "sets" if arrays else "signatures")
    wanted.destroy()  # else the executors keep every step's bitmap until the driver collects its garbage
    return found


def _compatible(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def bounded(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, percent: int) -> np.ndarray:
    """Whether the signatures' differing bits leave room for the overlap that the sizes need."""
    most = (nx + ny - np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)) // 2
    return most * 100 >= percent * (nx + ny - most)


def _signatures(column_: pa.Array) -> np.ndarray:
    joined = b"".join(column_.to_pylist())
    return np.frombuffer(joined, np.uint64).reshape(len(column_), SIGNATURE_BITS // 64)


def _confirmed(docs: DataFrame, text: str, width: int, percent: int, pairs: DataFrame) -> DataFrame:
    """``(a, b, overlap)``: the pairs whose exact intersection is large enough."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = _sets(docs, text, width, ends, arrays=True)
    pairs = _wide_pairs(pairs, sets, percent)
    x = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("data").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("data").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common = []
            for one, two in zip(batch.column(2), batch.column(3), strict=True):
                one = np.frombuffer(one.as_buffer(), np.uint64)
                two = np.frombuffer(two.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(two, one), len(two) - 1)
                common.append(int((two[at] == one).sum()))
            yield pa.record_batch(
                [*batch.columns[:2], *batch.columns[4:], pa.array(common, pa.int64())],
                names=["a", "b", "na", "nb", "overlap"],
            )

    return (
        pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y", "na", "nb")
        .mapInArrow(run, "a binary, b binary, na long, nb long, overlap long")
        .where(F.col("overlap") * 100 >= (F.col("na") + F.col("nb") - F.col("overlap")) * percent)
        .select("a", "b", "overlap")
    )


def _wide_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose wide signatures leave room for a link."""
    x = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("wide").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("wide").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = [differing_bits(*p) for p in zip(*(batch.column(i).to_pylist() for i in (2, 3)), strict=True)]
            both = batch.column(4).to_numpy() + batch.column(5).to_numpy()
            most = (both - np.array(apart, np.int64)) // 2
            kept = batch.filter(pa.array(most * 100 >= percent * (both - most)))
            yield pa.record_batch(kept.columns[:2], names=["a", "b"])

    sized = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y", "na", "nb")
    return written(sized.mapInArrow(run, "a binary, b binary"), "wide_pairs")


def _pivot_pairs(rows: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """Each set with the least sets, by a few orders, of each of its elements."""
    ranks = [F.xxhash64("node", F.lit(i)) for i in range(PIVOTS)]
    pivots = rows.groupBy("e").agg(
        F.array_distinct(F.array(*[F.min_by("node", r) for r in ranks])).alias("pivots")
    )
    pairs = (
        rows.join(pivots, "e")
        .select("node", F.explode("pivots").alias("pivot")).where("node <> pivot")
        .select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
        .distinct()
    )
    x = signatures.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("data").alias("x"))
    y = signatures.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("data").alias("y"))
    sized = pairs.join(x, "a").join(y, "b").where(_compatible(F.col("na"), F.col("nb"), percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nx, ny = (batch.column(i).to_numpy() for i in (4, 5))
            ok = bounded(_signatures(batch.column(2)), _signatures(batch.column(3)), nx, ny, percent)
            kept = batch.filter(pa.array(ok))
            yield pa.record_batch(kept.columns[:2], names=["a", "b"])

    return sized.select("a", "b", "x", "y", "na", "nb").mapInArrow(run, "a binary, b binary")


def _tile_pairs(rows: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets with a common leading element and differing ``comp`` that pass the bounds.

    ``rows`` has (e, node, comp). A tile holds two blocks of sets of one element, from one size
    band and the band below it.
    """
    rows = rows.join(signatures.select("node", "n"), "node")
    step = math.log(100 / percent) if percent < 100 else math.log(2)
    band = F.floor(F.log("n") / F.lit(step) + F.lit(1e-9))
    placed = rows.withColumn(
        "place",
        F.explode(
            F.array(
                F.struct(band.alias("band"), F.lit(True).alias("home")),
                F.struct((band + 1).alias("band"), F.lit(False).alias("home")),
            )
        ),
    ).select("*", "place.band", "place.home")
    blocks = (
        placed.groupBy("e", "band")
        .agg(
            F.count(F.lit(1)).alias("rows"), F.count_if("home").alias("homes"),
            F.min("comp").alias("lo"), F.max("comp").alias("hi"),
        )
        .where("rows > 1 and homes > 0 and lo <> hi")
        .select("e", "band", F.ceil(F.col("rows") / BLOCK_ROWS).alias("blocks"))
    )
    block = F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks"))
    dealt = (
        placed.join(blocks, ["e", "band"])
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select(
            F.xxhash64("e", "band", F.least("block", "other"), F.greatest("block", "other")).alias("tile"),
            "node", "comp", "n", "home", "block",
        )
        .join(signatures.select("node", "data"), "node")
        .select("tile", "node", "comp", "n", "data", "home", "block")
    )

    def compare(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        col = {c: t.column(c).combine_chunks() if isinstance(t.column(c), pa.ChunkedArray) else t.column(c) for c in t.column_names}
        tile, comp, n, block = (col[c].to_numpy(zero_copy_only=False) for c in ("tile", "comp", "n", "block"))
        home = col["home"].to_numpy(zero_copy_only=False)
        bits = _signatures(col["data"])
        ends = np.append(np.flatnonzero(np.diff(tile)) + 1, len(tile))
        last = np.repeat(ends, np.diff(np.concatenate([[0], ends]))) - 1
        # a tile of two blocks leaves pairs inside a block to the block's own tile
        whole = np.concatenate([[0], ends[:-1]])
        alone = np.repeat(
            np.minimum.reduceat(block, whole) == np.maximum.reduceat(block, whole),
            np.diff(np.concatenate([[0], ends])),
        )
        at, far, one, two = np.arange(len(tile)), 0, [], []
        while True:
            far += 1
            at = at[at + far <= last[at]]
            if not len(at):
                break
            to = at + far
            ok = (comp[at] != comp[to]) & (home[at] | home[to]) & (alone[at] | (block[at] != block[to]))
            ok &= np.minimum(n[at], n[to]) * 100 >= np.maximum(n[at], n[to]) * percent
            i, j = at[ok], to[ok]
            if len(i):
                ok = bounded(bits[i], bits[j], n[i], n[j], percent)
                one.append(i[ok])
                two.append(j[ok])
        i = pa.array(np.concatenate([np.zeros(0, np.int64), *one]))
        j = pa.array(np.concatenate([np.zeros(0, np.int64), *two]))
        return pa.record_batch([col["node"].take(i), col["node"].take(j)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the rows of a tile that the next batch may continue
        for batch in batches:
            if not batch.num_rows:
                continue
            tile = batch.column(0).to_numpy()
            cut = int(np.searchsorted(tile, tile[-1]))
            if cut or held and held[-1].column(0)[0].as_py() != tile[0]:
                done = [*held, batch.slice(0, cut)] if cut else held
                yield compare(pa.Table.from_batches(done))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield compare(pa.Table.from_batches(held))

    return (
        dealt.repartition("tile").sortWithinPartitions("tile")
        .mapInArrow(run, "a binary, b binary")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .where("a <> b")
        .distinct()
    )


def _shared_leads(docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """``(e, node)``: leading elements that two sets or more have in their leading parts."""
    context = docs.sparkSession.sparkContext
    frequent = context.broadcast(_frequent(docs, key, text, width))
    heads = _lead_rows(docs, text, width, percent, frequent).select("e", _node_bits("node").alias("h"))
    span = heads.groupBy("e").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    shared = written(span.where("lo <> hi").select("e"), "shared")
    wanted = context.broadcast(_bitmap_of(shared, "e"))
    rows = _lead_rows(docs, text, width, percent, frequent, wanted)
    leads = written(rows.join(shared, "e", "left_semi").distinct(), "leads")
    for held in (frequent, wanted):
        held.destroy()
    return leads


def jaccard_links(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE, percent: int = PERCENT
) -> tuple[DataFrame, DataFrame]:
    """Members ``(key, n_shingles, node)`` and all links ``(a, b, overlap)`` between differing sets.

    ``node`` names a shingle set: rows with equal sets share it, and linking them is implied.
    """
    members = written(members_of(docs, key, text, width), "members")
    rows = _shared_leads(docs, key, text, width, percent)
    signatures = _sets(docs, text, width, rows, arrays=False)
    pairs = _tile_pairs(rows.withColumn("comp", F.xxhash64("node")), signatures, percent)
    return members, _confirmed(docs, text, width, percent, written(pairs, "pairs"))


def near_duplicate_classes(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """``(key, n_shingles, component_id)`` of every row of ``docs``.

    Two rows link when their sets of ``width``-word shingles (A-Z in lower case) have a Jaccard
    similarity of ``percent`` percent or more; ``component_id`` is the least key that links reach.
    A text with fewer words is one shingle. A text without words, or a null one, has an empty set,
    links with nothing and is its own component. Rows with equal texts are always linked, rows
    with a null key too; a component of null keys alone has a null id. An empty table gives an
    empty result.
    """
    members = written(members_of(docs, key, text, width), "members")
    rows = _shared_leads(docs, key, text, width, percent)
    signatures = _sets(docs, text, width, rows, arrays=False)
    near = written(_pivot_pairs(rows, signatures, percent), "pivot_pairs")
    links = written(_confirmed(docs, text, width, percent, near), "pivot_links")
    parts = written(components(links), "parts")
    named = rows.join(parts, "node", "left").select(
        "e", "node", F.xxhash64(F.coalesce("comp", "node")).alias("comp")
    )
    rest = written(_tile_pairs(named, signatures, percent), "tile_pairs")
    more = written(_confirmed(docs, text, width, percent, rest), "tile_links")
    whole = written(components(links.unionByName(more)), "classes")
    least = members.where("node is not null").groupBy("node").agg(F.min("key").alias("least"))
    classed = least.join(whole, "node", "left").select(
        "node", "least", F.coalesce("comp", "node").alias("comp")
    )
    firsts = classed.groupBy("comp").agg(F.min("least").alias("component_id"))
    ids = classed.join(firsts, "comp").select("node", "component_id")
    return members.join(ids, "node", "left").select(
        F.col("key").alias(key), "n_shingles",
        F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("component_id")).alias("component_id"),
    )
