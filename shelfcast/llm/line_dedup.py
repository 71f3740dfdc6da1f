"""Lines that many documents share, found with two Bloom filters and confirmed exactly.

A first pass sets, for the hash of every line key of every document, a bit in a filter of keys
seen once and, when that bit is set already, in a filter of keys seen twice. Tasks send the bits
that they set, cut into chunks; merging a chunk adds to the twice-seen bits those that two tasks
saw once each. Only lines whose key is in the twice-seen filter are shuffled. They are counted
per key exactly (by a 128-bit digest of the key), so a false positive of the filter costs a row
in that shuffle and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import STEP_BYTES, column, pieces, text_bytes, whole_text

#: Bits of one filter, as a power of two: 16 MB, which is also the size of what is broadcast.
#: A fuller filter lets more single lines through to the exact count; results don't change.
FILTER_BITS = 27
_CHUNK_BITS = 15


def line_keys(text: bytes) -> list[bytes]:
    """Of each line: ASCII white space stripped at both ends, A-Z in lower case."""
    return [line.strip().lower() for line in text.split(b"\n")]


def _positions(text: bytes, bits: int) -> list[int]:
    mask = (1 << bits) - 1
    return [xxhash.xxh3_64_intdigest(key) & mask for key in set(line_keys(text)) if key]


def _set_bits(bits: int):
    """One row per chunk that a task touches: the bits it saw once or more, and twice or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in batches:
            for piece in pieces(batch, 0, STEP_BYTES):
                here: list[int] = []
                for text in piece.column(0).to_pylist():
                    here += _positions(text, bits)
                found.append(np.array(here, np.uint32))
        if not found:
            return
        at, seen = np.unique(np.concatenate(found), return_counts=True)
        chunk = at >> _CHUNK_BITS
        cuts = np.flatnonzero(np.diff(chunk)) + 1
        low = (at & ((1 << _CHUNK_BITS) - 1)).astype(np.uint16)
        parts = list(zip(np.split(low, cuts), np.split(seen, cuts), strict=True))
        parts = parts if len(at) else []
        yield pa.record_batch(
            [
                pa.array(chunk[np.r_[0, cuts]] if len(at) else [], pa.int32()),
                pa.array([p.tobytes() for p, _ in parts], pa.binary()),
                pa.array([p[n > 1].tobytes() for p, n in parts], pa.binary()),
            ],
            names=["chunk", "once", "twice"],
        )

    return run


def _merge_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams the rows of its chunks; holds two bitmaps of 4 KB per chunk."""
    once: dict[int, np.ndarray] = {}
    twice: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, one, two in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if chunk not in once:
                once[chunk] = np.zeros(1 << _CHUNK_BITS, bool)
                twice[chunk] = np.zeros(1 << _CHUNK_BITS, bool)
            one, two = np.frombuffer(one, np.uint16), np.frombuffer(two, np.uint16)
            twice[chunk][one[once[chunk][one]]] = True
            twice[chunk][two] = True
            once[chunk][one] = True
    some = sorted(c for c, bits in twice.items() if bits.any())
    yield pa.record_batch(
        [
            pa.array(some, pa.int32()),
            pa.array([np.packbits(twice[c], bitorder="little").tobytes() for c in some], pa.binary()),
        ],
        names=["chunk", "twice"],
    )


def twice_seen(docs: DataFrame, text: str = "text", bits: int = FILTER_BITS) -> np.ndarray:
    """The filter of line keys that two documents or more may hold: ``2 ** bits`` bits.

    Its size is a parameter and doesn't grow with the documents, so the driver can take it.
    """
    merged = (
        docs.select(text_bytes(text).alias("text"))
        .mapInArrow(_set_bits(bits), "chunk int, once binary, twice binary")
        .repartition("chunk")
        .mapInArrow(_merge_bits, "chunk int, twice binary")
        .collect()
    )
    whole = np.zeros(1 << (bits - 3), np.uint8)
    width = 1 << (_CHUNK_BITS - 3)
    for row in merged:
        whole[row["chunk"] * width : (row["chunk"] + 1) * width] = np.frombuffer(
            row["twice"], np.uint8
        )
    return whole


def drop_repeated_lines(
    docs: DataFrame,
    min_docs: int = 2,
    keep: str = "first",
    text: str = "text",
    order: str = "doc_id",
    bits: int = FILTER_BITS,
) -> DataFrame:
    """``docs`` without the lines whose key ``min_docs`` documents or more hold.

    ``keep="none"`` drops them everywhere. ``keep="first"`` leaves, in the document that comes
    first by ``order`` (nulls last, then by text), the first line with that key. Blank lines have
    an empty key and always stay. Kept lines are joined by one line feed. Adds ``n_lines``
    (before dropping) and ``n_dropped``, replacing columns of those names; the other columns stay.

    A null text counts as empty, which is one blank line; a text that loses all lines is empty.
    Every row is a document, so equal rows count as often as they occur, and rows that are equal
    in ``order`` and text share the first place. An empty table gives an empty result.
    Memory: a task holds the hashes of its own lines, and one filter of ``2 ** bits`` bits.
    """
    if keep not in ("first", "none"):
        raise ValueError(f"keep is 'first' or 'none', not {keep!r}")
    if bits < _CHUNK_BITS:
        raise ValueError(f"a filter has {_CHUNK_BITS} bits, as a power of two, at least")
    spark = docs.sparkSession
    filter_ = spark.sparkContext.broadcast(twice_seen(docs, text, bits))
    mask = (1 << bits) - 1

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = filter_.value
        for batch in batches:
            for piece in pieces(batch, 0, STEP_BYTES):
                rows, keys = [], []
                for row, body in enumerate(piece.column(0).to_pylist()):
                    for key in set(line_keys(body)):
                        at = xxhash.xxh3_64_intdigest(key) & mask
                        if key and seen[at >> 3] >> (at & 7) & 1:
                            rows.append(row)
                            keys.append(xxhash.xxh3_128_digest(key))
                taken = pa.array(rows, pa.int64())
                yield pa.record_batch(
                    [pa.array(keys, pa.binary()), *(piece.column(i).take(taken) for i in (1, 2))],
                    names=["key", "digest", "place"],
                )

    # a text decides which of its lines go, whatever row holds it: copies share one decision
    place = F.struct(
        column(order).isNull().alias("last"), column(order).alias("by"),
        F.md5(whole_text(text)).alias("digest"),
    )
    digest = F.md5(whole_text(text))
    place_type = docs.select(place.alias("p")).schema["p"].dataType.simpleString()
    lines = docs.select(
        text_bytes(text).alias("text"), digest.alias("digest"), place.alias("place")
    ).mapInArrow(suspects, f"key binary, digest string, place {place_type}")
    counted = (
        lines.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.min("place").alias("first"))
        .where(F.col("n_docs") >= min_docs)
        .drop("n_docs")
    )
    spread = lines.groupBy("digest", "key").agg(F.min("place").alias("place"))
    gone = (
        spread.join(counted, "key")
        .groupBy("digest")
        .agg(F.collect_list(F.struct("key", "first")).alias("gone"))
    )
    row = F.struct(*[column(c) for c in docs.columns])
    with_gone = docs.select(row.alias("row"), digest.alias("digest"), place.alias("place")).join(
        gone, "digest", "left"
    )
    body = F.coalesce(F.col("row").getField(text).cast("string"), F.lit("")).cast("binary")
    return _without(with_gone, body, keep, docs, text)


def _without(with_gone: DataFrame, body, keep: str, docs: DataFrame, text: str) -> DataFrame:
    """Applies each row's list of dropped keys to its text."""
    mine = F.transform(
        F.coalesce(F.col("gone"), F.expr("array()").cast(with_gone.schema["gone"].dataType)),
        lambda g: F.struct(g["key"].alias("key"), (g["first"] == F.col("place")).alias("first")),
    )
    others = [c for c in docs.columns if c.lower() not in (text.lower(), "n_lines", "n_dropped")]
    packed = with_gone.select(
        body.alias("text"),
        F.transform(mine, lambda g: g["key"]).alias("keys"),
        F.transform(mine, lambda g: g["first"]).alias("firsts"),
        F.struct(F.lit(1).alias("x"), *[F.col("row").getField(c).alias(f"c{i}") for i, c in enumerate(others)]).alias("row"),
    )
    row_type = packed.schema["row"].dataType.simpleString()
    keep_first = keep == "first"

    def apply(piece: pa.RecordBatch) -> pa.RecordBatch:
        texts, lines_in, dropped = [], [], []
        for data, keys, firsts in zip(*(piece.column(i).to_pylist() for i in range(3)), strict=True):
            lines = data.split(b"\n")
            lines_in.append(len(lines))
            if keys:
                spare = {k for k, f in zip(keys, firsts, strict=True) if f and keep_first}
                going, left = set(keys), []
                for line in lines:
                    digest = xxhash.xxh3_128_digest(line.strip().lower())
                    if digest in spare:
                        spare.discard(digest)
                    elif digest in going:
                        continue
                    left.append(line)
                dropped.append(len(lines) - len(left))
                data = b"\n".join(left)
            else:
                dropped.append(0)
            texts.append(data)
        return pa.record_batch(
            [
                pa.array(texts, pa.binary()), pa.array(lines_in, pa.int64()),
                pa.array(dropped, pa.int64()), piece.column(3),
            ],
            names=["text", "n_lines", "n_dropped", "row"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 0, STEP_BYTES):
                yield apply(piece)

    done = packed.mapInArrow(run, f"text binary, n_lines long, n_dropped long, row {row_type}")
    at = {c: i for i, c in enumerate(others)}
    return done.select(
        *[
            F.col("text").cast("string").alias(c) if c not in at
            else F.col("row").getField(f"c{at[c]}").alias(c)
            for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")
        ],
        "n_lines", "n_dropped",
    )
