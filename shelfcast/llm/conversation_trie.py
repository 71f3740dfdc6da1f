"""The prefix trie of conversations, from padded matrices of turn ids over range shards.

A conversation is the sequence of its turns; a node of the trie is a sequence of first turns that
some conversation has. Conversations are cut into ranges of their lexicographic order, one shard
each. A shard is a matrix: a row per conversation, a turn's 128-bit id per column, padded with
zeros. ``numpy.lexsort`` orders the rows; where a column changes from one row to the next, an
OR-accumulation along the row tells at which depths the node ends there and a new one starts; and
``reduceat`` over the node starts aggregates a depth at a time.

A shard's cuts are conversations themselves, so each shard knows the row that follows its last one
and counts a node's text, its leaves and its place among its parent's children where the node ends.
All figures then add up over shards. Nodes on the path of a shard's first or last row may go on in
its neighbours; their parts are added up in a last step, a stream of one row per shard and depth.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import column, whole_text, written

#: Turns of a shard, and cells of one matrix; a shard beyond that is cut again inside its task.
SHARD_TURNS, CELLS = 1 << 18, 1 << 21
#: Sampled conversations for each cut, and bytes of them on the driver. They decide balance only.
OVERSAMPLE, SAMPLE_BYTES = 32, 64_000_000
_ID = 16  # bytes of a turn's id
_EMPTY = hashlib.sha256(b"").hexdigest()

_PARTS = pa.schema(
    [
        ("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("conv_id", pa.int64()),
        ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
        ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("first_end", pa.int64()), ("ends", pa.string()),
    ]
)
_PARTS_DDL = (
    "node binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, first_end long, ends string"
)
NODE_COLUMNS = (
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
)


def turn_sequences(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``(conv_id, turns)``: each conversation's turns as structs ``(id, size)``, in order.

    ``id`` is a 128-bit digest of role and text, ``size`` the text's UTF-8 bytes; a null role or
    text counts as empty. Order: by turn, null first, equal ones by id. Rows with a null
    conversation belong to none and are left out. Texts are not shuffled, 20 bytes a turn are; a
    conversation's ids are held together in one task, as any row of a table is.
    """
    said, who = whole_text(text), whole_text(role)
    named = F.md5(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said).cast("binary"))
    one = F.struct(column(turn).alias("turn"), F.unhex(named).alias("id"), F.octet_length(said).alias("size"))
    rows = conversations.where(column(conv).isNotNull()).select(column(conv).cast("long").alias("conv_id"), one.alias("t"))
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return listed.select("conv_id", F.transform("turns", lambda t: F.struct(t["id"].alias("id"), t["size"].alias("size"))).alias("turns"))


def regrafted(sequences: DataFrame, base: Column, head: Column, longest: int) -> DataFrame:
    """``sequences`` whose first ``head`` turns (``longest`` at most) are those of conversation
    ``base``: all that has if it is shorter, none if there is no such conversation."""
    heads = sequences.select(F.col("conv_id").alias("base"), F.slice("turns", 1, longest).alias("heads"))
    joined = sequences.withColumns({"base": base, "head": head.cast("int")}).join(heads, "base", "left")
    none = F.slice("turns", 1, 0)
    front = F.coalesce(F.slice("heads", F.lit(1), F.col("head")), none)
    rest = F.slice("turns", F.col("head") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return joined.select("conv_id", F.concat(front, rest).alias("turns"))


def _keys(ids: pa.ListArray, sizes: pa.ListArray) -> tuple[list[bytes], list[bytes]]:
    """Each row's ids, and its sizes as 32-bit numbers, as one string of bytes."""
    at = ids.offsets.to_numpy()
    at = at - at[0]
    flat = b"".join(ids.flatten().to_pylist())
    numbers = sizes.flatten().to_numpy(zero_copy_only=False).astype("<i4").tobytes()
    bounds = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
    return [flat[_ID * a : _ID * b] for a, b in bounds], [numbers[4 * a : 4 * b] for a, b in bounds]


def _paths(key: bytes) -> list[bytes]:
    """A digest of each prefix of a row's ids, the empty one first."""
    state, found = hashlib.md5(), []
    for at in range(0, len(key) + _ID, _ID):
        found.append(state.digest())
        state.update(key[at : at + _ID])
    return found


def _padded(key_rows: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of all rows as two matrices of 64-bit halves, and the rows' lengths."""
    lengths = np.array([len(k) // _ID for k in key_rows], np.int64)
    flat = np.frombuffer(b"".join(key_rows), ">u8").astype(np.uint64).reshape(-1, 2)
    row = np.repeat(np.arange(len(key_rows)), lengths)
    col = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    high, low = np.zeros((2, len(key_rows), width), np.uint64)
    high[row, col], low[row, col] = flat[:, 0], flat[:, 1]
    return high, low, lengths


def matrix_nodes(
    keys: list[bytes], convs: np.ndarray, sizes: list[bytes], after: bytes | None, ordered: bool = False
) -> pa.RecordBatch:
    """The nodes of one shard. ``after``: the ids of the row that follows it, None after the last.

    A node that may have parts in other shards has ``node``, a digest of its path, and its own
    conversations' ids as ``ends``; a whole one has the digest of those, and null for ``node``.
    ``parent`` is set where the parent may have other parts, else ``parent_conv_id`` is known.
    """
    width = max(len(k) for k in keys) // _ID
    high, low, lengths = _padded(keys, width)
    if not ordered:
        by = [convs, lengths]
        for d in reversed(range(width)):
            by += [low[:, d], high[:, d]]
        order = np.lexsort(by)
        high, low, lengths, convs = high[order], low[order], lengths[order], convs[order]
        keys, sizes = [keys[i] for i in order], [sizes[i] for i in order]
    n = len(keys)
    weight = np.zeros((n, width + 1), np.int64)
    row = np.repeat(np.arange(n), lengths)
    col = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    weight[row, col + 1] = np.frombuffer(b"".join(sizes), "<i4")

    # over[i, d]: the node of depth d that holds row i doesn't hold the row after it
    over = np.zeros((n, width + 1), bool)
    over[:-1, 1:] = (high[:-1] != high[1:]) | (low[:-1] != low[1:])
    if after is None:
        over[-1] = True
    elif width:
        next_high, next_low, _ = _padded([after[: width * _ID]], width)
        over[-1, 1:] = (high[-1] != next_high[0]) | (low[-1] != next_low[0])
    np.logical_or.accumulate(over, axis=1, out=over)
    exists = np.arange(width + 1) <= lengths[:, None]
    ends = over & exists
    starts = np.ones((n, width + 1), bool)
    starts[1:] = over[:-1]
    leaf = ends[np.arange(n), lengths].astype(np.int64)
    # a node's text counts for each of its conversations but one: the one with which it ends
    saved = np.where(exists & ~ends, weight, 0)[:, ::-1].cumsum(axis=1)[:, ::-1]
    first_path, last_path = _paths(keys[0]), _paths(keys[-1])

    batches = []
    above: tuple[np.ndarray, ...] = ()
    for d in range(width + 1):
        at = np.flatnonzero(starts[:, d])
        bound = np.append(at[1:], n)
        least = np.minimum.reduceat(convs, at)
        open_ = exists[at, d] & ((at == 0) | ~ends[bound - 1, d])
        path = first_path[d] if d < len(first_path) else None
        tail = last_path[d] if d < len(last_path) else None
        names = [None if not o else path if a == 0 else tail for o, a in zip(open_.tolist(), at.tolist(), strict=True)]
        own = lengths == d
        n_own = np.add.reduceat(own.astype(np.int64), at)
        children = np.add.reduceat(ends[:, d + 1].astype(np.int64), at) if d < width else np.zeros(len(at), np.int64)
        ended: list[str] = [None if o else _EMPTY for o in open_.tolist()]
        for k in np.flatnonzero(n_own).tolist():
            text = ",".join(map(str, convs[at[k] : at[k] + n_own[k]].tolist()))
            ended[k] = text if open_[k] else hashlib.sha256(text.encode()).hexdigest()
        if d:
            up = np.searchsorted(above[0], at, "right") - 1
            parent = [above[2][u] for u in up.tolist()]
            known = pa.array(above[1][up], pa.int64(), mask=np.array([p is not None for p in parent], bool))
        else:
            parent, known = [None] * len(at), pa.nulls(len(at), pa.int64())
        whole = pa.record_batch(
            [
                pa.array(names, pa.binary()), pa.array(parent, pa.binary()),
                pa.array(np.full(len(at), d), pa.int64()), pa.array(least), known,
                pa.array(bound - at, pa.int64()), pa.array(children), pa.array(np.add.reduceat(leaf, at)),
                pa.array(np.add.reduceat(saved[:, d], at)),
                pa.array(convs[at], pa.int64(), mask=~((n_own > 0) & open_)), pa.array(ended, pa.string()),
            ],
            schema=_PARTS,
        )
        batches.append(whole.filter(pa.array(exists[at, d])))
        above = at, least, names
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def shard_nodes(keys: list[bytes], convs: np.ndarray, sizes: list[bytes], after: bytes | None, cells: int = CELLS):
    """The nodes of a shard of any size, matrix by matrix: long rows are padded only among each other."""
    width = max(map(len, keys)) // _ID + 1
    if len(keys) * width <= cells:
        yield matrix_nodes(keys, convs, sizes, after)
        return
    order = sorted(range(len(keys)), key=lambda i: (keys[i], convs[i]))
    begin, widest = 0, 0
    for at, i in enumerate(order):
        widest = max(widest, len(keys[i]) // _ID + 1)
        if at > begin and (at - begin + 1) * widest > cells:
            part = order[begin:at]
            yield matrix_nodes([keys[j] for j in part], convs[part], [sizes[j] for j in part], keys[i], True)
            begin, widest = at, len(keys[i]) // _ID + 1
    part = order[begin:]
    yield matrix_nodes([keys[j] for j in part], convs[part], [sizes[j] for j in part], after, True)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the parts of each node. They come ordered by node and by their first own conversation;
    the digest of a node's conversations reads them one part after the other."""
    now, state, any_end, out = None, None, False, []

    def closed() -> None:
        out.append({**now, "ends": state.hexdigest(), "first_end": None})

    for batch in batches:
        for part in batch.to_pylist():
            if now is None or now["node"] != part["node"]:
                if now:
                    closed()
                now, state, any_end = part, hashlib.sha256(), False
            else:
                now["conv_id"] = min(now["conv_id"], part["conv_id"])
                for name in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                    now[name] += part[name]
            if part["ends"]:
                state.update((("," if any_end else "") + part["ends"]).encode())
                any_end = True
                now["ends"] = None
        if len(out) > 10_000:
            yield pa.RecordBatch.from_pylist(out, _PARTS)
            out.clear()
    if now:
        closed()
    yield pa.RecordBatch.from_pylist(out, _PARTS)


def _cuts(sequences: DataFrame, n: int, turns: int, shard_turns: int) -> list[tuple[bytes, int]]:
    """Conversations at which the shards begin, in order: at most one in ``OVERSAMPLE`` of a sample."""
    width = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = min(n, max(width, math.ceil(turns / shard_turns)))
    if shards < 2:
        return []
    one_in = max(1, n // (OVERSAMPLE * shards), math.ceil(_ID * turns / SAMPLE_BYTES))
    some = sequences.where(F.pmod(F.xxhash64("conv_id"), F.lit(one_in)) == 0).select("conv_id", "turns.id").collect()
    rows = sorted((b"".join(map(bytes, r["id"])), r["conv_id"]) for r in some)
    shards = min(shards, max(1, len(rows) // 4 if one_in > 1 else len(rows)))
    at = {k * len(rows) // shards for k in range(1, shards)}
    return [rows[k] for k in sorted(at) if k]


def prefix_trie(sequences: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row for each distinct sequence of first turns of ``sequences`` (conv_id, turns).

    ``conv_id``: the smallest conversation that starts with it; ``depth``: its turns;
    ``parent_conv_id``: the smallest one of its parent, null for the root (depth 0); ``n_convs``;
    ``n_children``; ``n_leaves``: childless nodes of its subtree, itself included; ``saved_tokens``:
    over its subtree, the bytes of a node's last text times its conversations but one;
    ``ends_sha256``: of the conversations that end here, ascending, comma-joined.

    ``conv_id`` must be distinct. A conversation without turns is a member of the root alone. No
    conversation: an empty result, without a root. Equal conversations, however many, are spread
    over shards as others are. A very long one makes a matrix of its own. The digest of a node's
    conversations is read in one stream, which holds no more than one shard's part.
    """
    spark = sequences.sparkSession
    listed = written(sequences.withColumn("n", F.size("turns")), "sequences")
    n, turns = listed.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = _cuts(listed, n, turns, shard_turns)
    cuts = spark.sparkContext.broadcast(found)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes = _keys(batch.column(1), batch.column(2))
            convs = batch.column(0)
            shard = [bisect_right(cuts.value, pair) for pair in zip(keys, convs.to_pylist(), strict=True)]
            yield pa.record_batch(
                [pa.array(shard, pa.int32()), convs, pa.array(keys, pa.binary()), pa.array(sizes, pa.binary())],
                names=["shard", "conv_id", "key", "sizes"],
            )

    def nodes(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        shard = table["shard"][0].as_py()
        after = cuts.value[shard][0] if shard < len(cuts.value) else None
        parts = shard_nodes(
            table["key"].to_pylist(), table["conv_id"].to_numpy(), table["sizes"].to_pylist(), after
        )
        return pa.Table.from_batches(parts, _PARTS)

    sharded = listed.select("conv_id", "turns.id", "turns.size").mapInArrow(
        dealt, "shard int, conv_id long, key binary, sizes binary"
    )
    # shard k to partition k, which AQE doesn't merge: a shard is much work for few bytes
    sharded = sharded.repartitionById(len(found) + 1, "shard")
    parts = written(sharded.groupBy("shard").applyInArrow(nodes, _PARTS_DDL), "trie-parts")
    open_ = parts.where(F.col("node").isNotNull()).repartition("node").sortWithinPartitions("node", "first_end")
    merged = written(open_.mapInArrow(_merged, _PARTS_DDL), "trie-borders")
    known = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("above"))
    whole = parts.where(F.col("node").isNull())
    below = whole.where(F.col("parent").isNotNull()).unionByName(merged.where(F.col("parent").isNotNull()))
    below = below.join(known, "parent").withColumn("parent_conv_id", F.col("above")).drop("above")
    rest = whole.where(F.col("parent").isNull()).unionByName(merged.where(F.col("parent").isNull()))
    return rest.unionByName(below).withColumnRenamed("ends", "ends_sha256").select(*NODE_COLUMNS)
