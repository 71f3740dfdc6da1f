"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

A text gets a whitespace marker in front and one for each space. Pieces hold markers at their front
only, so the text falls into units (markers, then what follows up to the next marker), and the best
path of the whole text is the best paths of its units. Units are encoded once in each batch of
documents, all of one length together. Bytes that no better piece covers fall back to byte pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import STEP_BYTES, column, pieces, text_bytes
from .lattice import MARK, Trie, best_paths, viterbi
from .pieces_file import MODEL, Pieces, read_pieces

_UNIT = re.compile(rb" *[^ ]+| +")
#: Units whose ids a task keeps from batch to batch.
MOST_CACHED = 200_000


class Units:
    """The ids of units that a task has encoded, one after another in one array."""

    def __init__(self) -> None:
        self.row: dict[bytes, int] = {}
        self.begins, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)
        self._new: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, units: list[bytes], sizes: np.ndarray, ids: np.ndarray) -> None:
        self.row.update(zip(units, range(len(self.row), len(self.row) + len(units)), strict=True))
        self._new.append((sizes, ids))

    def get(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the units in these rows, one after another, and how many each has."""
        if self._new:
            sizes, ids = zip(*self._new, strict=True)
            self._new = []
            self.sizes = np.concatenate([self.sizes, *sizes])
            self.ids = np.concatenate([self.ids, *ids])
            self.begins = np.cumsum(self.sizes) - self.sizes
        sizes = self.sizes[rows]
        shift = self.begins[rows] - (np.cumsum(sizes) - sizes)
        return self.ids[np.repeat(shift, sizes) + np.arange(sizes.sum())], sizes

    def keep(self, units: set[bytes]) -> None:
        """Forgets all units but these."""
        rows = {u: row for u in units if (row := self.row.get(u)) is not None}
        self.ids, self.sizes = self.get(np.fromiter(rows.values(), np.int64, len(rows)))
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.row = dict(zip(rows, range(len(rows)), strict=True))


@dataclass
class Encoder:
    """Vocabulary and trie; sent to the tasks once (a few megabytes, as large as the vocabulary)."""

    known: Pieces
    trie: Trie

    @property
    def plain(self) -> tuple:
        """Arrays, dicts and bytes, which a broadcast may hold; see ``of_plain``."""
        known = self.known
        return (known.normal, known.bytes_, known.scores, known.unknown, known.names), self.trie.plain

    @staticmethod
    def of_plain(known: tuple, trie: tuple) -> Encoder:
        return Encoder(Pieces(*known), Trie(*trie))

    @staticmethod
    def load(path: str = MODEL, zipf: bool = True) -> Encoder:
        known = read_pieces(path, zipf)
        mark = MARK.decode()
        crossing = [p for p in known.normal if mark in p.decode().lstrip(mark)]
        if crossing:
            raise ValueError(f"pieces that reach over a space are not supported: {crossing[:3]}")
        if (known.bytes_ < 0).any():
            raise ValueError("the model has no byte pieces to fall back to")
        return Encoder(known, Trie.of(known.normal))

    def encode_units(self, units: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For some units at a time, all once: their positions, how many ids each has, and the ids one
        after another. A marker character of the text itself is written in byte pieces."""
        rest = [i for i, unit in enumerate(units) if MARK in unit]
        by_marker = {i: units[i].split(MARK) for i in rest}
        byte_scores = self.known.scores[self.known.bytes_]
        common = self.trie, self.known.scores, byte_scores
        # a unit has spaces in front only
        plain = [b"" if i in by_marker else u.replace(b" ", MARK) for i, u in enumerate(units)]
        yield from best_paths(*common, plain, self.known.bytes_)
        for i, parts in by_marker.items():
            marker = self.known.bytes_[list(MARK)]
            found = viterbi(*common, [p.replace(b" ", MARK) for p in parts], self.known.bytes_)
            ids = np.concatenate([x for path in found for x in (marker, path)][1:])
            yield np.array([i]), np.array([len(ids)]), ids

    def encode(self, texts: list[bytes], cache: Units | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after another, and where each text's begin and end."""
        cache = Units() if cache is None else cache
        units, n_units = [], []
        for text in texts:
            found = _UNIT.findall(b" " + text) if text else []
            units += found
            n_units.append(len(found))
        distinct = set(units)
        if len(cache.row) + len(distinct - cache.row.keys()) > MOST_CACHED:
            cache.keep(distinct)
        order = list(distinct - cache.row.keys())
        for at, sizes, ids in self.encode_units(order):
            cache.add([order[i] for i in at.tolist()], sizes, ids)
        ids, sizes = cache.get(np.fromiter(map(cache.row.__getitem__, units), np.int64, len(units)))
        return ids, np.cumsum([0, *sizes])[np.cumsum([0, *n_units])]

    def surface(self) -> list[bytes]:
        """The bytes that each id stands for, the marker as a space."""
        names = [n.replace(MARK, b" ") for n in self.known.names]
        for byte, i in enumerate(self.known.bytes_.tolist()):
            names[i] = bytes([byte])
        return names

    def decode(self, ids: np.ndarray, surface: list[bytes] | None = None) -> bytes:
        """The text of the ids: markers as spaces, without the one in front; bytes put together."""
        surface = surface or self.surface()
        return b"".join([surface[i] for i in ids.tolist()])[1:] if len(ids) else b""


def encode_documents(docs: DataFrame, path: str = MODEL, text: str = "text", zipf: bool = True) -> DataFrame:
    """Every row with ``ids`` (array of piece ids), ``n_pieces``, ``n_byte_pieces`` (byte pieces
    among them) and ``round_trip`` (decoding gives the text back).

    A null or empty text has no ids. Texts with several spaces, other white space, marker characters
    or characters outside the vocabulary come back exactly. Columns of these names are replaced,
    others stay. Memory: a few megabytes of text at a time, and a bounded cache of units.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Encoder.load(path, zipf).plain)
    added = ("ids", "n_pieces", "n_byte_pieces", "round_trip")
    others = [c for c in docs.columns if c.lower() not in added]
    row = F.struct(F.lit(1).alias("x"), *[column(c).alias(f"c{i}") for i, c in enumerate(others)])
    packed = docs.select(text_bytes(text).alias("text"), row.alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of_plain(*shared.value)
        surface, cache = encoder.surface(), Units()
        is_byte = np.zeros(len(surface) + 1, bool)
        is_byte[encoder.known.bytes_] = True
        for batch in batches:
            for piece in pieces(batch, 0, STEP_BYTES):
                texts = piece.column(0).to_pylist()
                ids, ends = encoder.encode(texts, cache)
                cut = [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
                same = [encoder.decode(c, surface) == t for c, t in zip(cut, texts, strict=True)]
                run_ = np.concatenate([[0], np.cumsum(is_byte[ids])])
                yield pa.record_batch(
                    [
                        piece.column(1),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())),
                        pa.array(np.diff(ends), pa.int64()), pa.array(np.diff(run_[ends]), pa.int64()),
                        pa.array(same, pa.bool_()),
                    ],
                    names=["row", *added],
                )

    kind = packed.schema["row"].dataType.simpleString()
    done = packed.mapInArrow(
        run, f"row {kind}, ids array<int>, n_pieces long, n_byte_pieces long, round_trip boolean"
    )
    return done.select(*[F.col("row").getField(f"c{i}").alias(c) for i, c in enumerate(others)], *added)


def decode_ids(df: DataFrame, ids: str = "ids", path: str = MODEL, name: str = "decoded") -> DataFrame:
    """``df`` with the text of its ids; null ids give a null text, bytes that are no text a sign."""
    shared = df.sparkSession.sparkContext.broadcast(Encoder.load(path).plain)

    @F.pandas_udf("string")
    def decoded(lists):
        encoder = Encoder.of_plain(*shared.value)
        surface = encoder.surface()
        return lists.map(
            lambda v: None if v is None else encoder.decode(np.asarray(v), surface).decode("utf-8", "replace")
        )

    text: Column = decoded(column(ids))
    return df.withColumn(name, text)
