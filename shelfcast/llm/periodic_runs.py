"""Maximal periodic runs of words, by online dyadic square catching.

Words come in order. Level ``B`` (a power of two) catches squares whose half has a length ``p`` in
``[2 B, 4 B)``: every completed block of ``B`` words at a multiple of ``B`` is a catcher, which
waits for its own words to come again ``p`` later. An appended word completes one suffix of ``B``
words per level, and exactly two catchers lie at the right distance from it, so a word costs two
comparisons of hashes per level, done for a whole stretch of appended words at once. A catch is a
bit; catches of consecutive blocks at one distance chain, and a chain long enough holds a square of
the wanted power. Chains are compared word by word and merge into runs: maximal stretches in which
words ``p`` apart are equal. A chain inside a run of a smaller period is that run again.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import STEP_BYTES, column, mixed, pieces, text_bytes

LEAST_LENGTH, LEAST_POWER = 24, 3
#: Words appended at a time.
STEP_WORDS = 1 << 16
_ROOT = 0x9E3779B97F4A7C15
_INVERSE = pow(_ROOT, -1, 1 << 64)

RUN_DDL = "array<struct<start: long, length: long, period: long>>"


class SquareCatcher:
    """Runs of at least ``power`` periods (2 or more) and ``length`` words among appended words.

    Words are numbers. Memory: about 40 bytes a word, and half a byte a word and level.
    """

    def __init__(self, length: int = LEAST_LENGTH, power: int = LEAST_POWER):
        if power < 2:
            raise ValueError("a run has two periods at least")
        self.length, self.power = length, power
        self.words = np.zeros(0, np.int64)
        self._sums = np.zeros(1, np.uint64)  # of the words' hashes, times powers of _ROOT
        self._down = np.ones(1, np.uint64)  # powers of the inverse
        self._caught: dict[int, list[np.ndarray]] = {}  # level: per slot, a bit for each start of a suffix

    def append(self, words: np.ndarray) -> None:
        """Words follow those given before."""
        for begin in range(0, len(words), STEP_WORDS):
            self._append(np.asarray(words[begin : begin + STEP_WORDS], np.int64))

    def _append(self, words: np.ndarray) -> None:
        old, n = len(self.words), len(self.words) + len(words)
        self.words = np.concatenate([self.words, words])
        up = np.full(len(words), _ROOT, np.uint64)
        up[0] = pow(_ROOT, old, 1 << 64)
        down = np.full(len(words), _INVERSE, np.uint64)
        down[0] = pow(_INVERSE, old + 1, 1 << 64)
        letters = mixed((words.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
        sums = np.cumsum(letters * np.cumprod(up), dtype=np.uint64) + self._sums[-1]
        self._sums = np.concatenate([self._sums, sums])
        self._down = np.concatenate([self._down, np.cumprod(down)])
        block = 1
        while 2 * block * self.power <= n:
            self._catch(block, n)
            block *= 2

    def _catch(self, block: int, n: int) -> None:
        """Suffixes of ``block`` words that are complete by now meet their two catchers."""
        seen = self._caught.setdefault(block, [np.zeros(0, bool), np.zeros(0, bool)])
        begin, end = len(seen[0]), n - block + 1
        if begin >= end:
            return
        suffix = np.arange(begin, end)
        mine = (self._sums[begin + block : end + block] - self._sums[begin:end]) * self._down[begin:end]
        first = (begin - 2 * block) // block if begin >= 2 * block else 0
        at = np.arange(max(0, first - 1) * block, end, block)
        at = at[at + block <= n]
        blocks = (self._sums[at + block] - self._sums[at]) * self._down[at]
        low = at[0] // block
        for slot in (0, 1):
            which = suffix // block - 2 - slot
            known = which >= 0
            caught = np.zeros(len(suffix), bool)
            caught[known] = mine[known] == blocks[which[known] - low]
            seen[slot] = np.concatenate([seen[slot], caught])

    def runs(self) -> list[tuple[int, int, int]]:
        """``(start, length, period)`` of all runs so far, by start, then period."""
        n = len(self.words)
        found: set[tuple[int, int]] = set()  # start, end
        runs = []
        reach = np.zeros(n + 1, np.int64)  # the furthest end of the runs that start here or before: the end
        # of a stretch with two periods or more is the end of the run with its smallest one

        def take(period: int, begin: int, end: int) -> None:
            """All maximal stretches of equal words ``period`` apart that touch ``begin .. end``."""
            while begin and self.words[begin - 1] == self.words[begin - 1 + period]:
                step = 1
                while step < begin and (self.words[begin - step : begin] == self.words[begin - step + period : begin + period]).all():
                    step *= 2
                step = min(step, begin)
                same = self.words[begin - step : begin] == self.words[begin - step + period : begin + period]
                wrong = np.flatnonzero(~same)
                begin = begin - step + int(wrong[-1]) + 1 if len(wrong) else begin - step
            size = max(end - begin, 1)
            while True:  # until a word behind the chain differs
                same = self.words[begin : n - period][:size] == self.words[begin + period :][:size]
                if begin + size >= n - period or not same[end - begin :].all():
                    break
                size *= 2
            edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]])))
            for a, b in zip((edges[::2] + begin).tolist(), (edges[1::2] + begin).tolist(), strict=True):
                length = b - a + period
                if a < end and length >= max(self.length, self.power * period) and (a, a + length) not in found:
                    found.add((a, a + length))
                    runs.append((a, length, period))

        if n >= self.power:
            same = np.concatenate([[False], self.words[1:] == self.words[:-1], [False]])
            edges = np.flatnonzero(same[1:] != same[:-1])
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                if b - a + 1 >= max(self.length, self.power):
                    found.add((a, b + 1))
                    runs.append((a, b + 1 - a, 1))
        for block in sorted(self._caught):
            for slot, bits in enumerate(self._caught[block]):
                if not bits.any():
                    continue
                # the whole blocks in a stretch of (power - 1) periods of the slot's shortest
                least = max(1, ((self.power - 1) * (2 + slot) * block - block + 1) // block)
                chain = bits
                for k in range(1, least):
                    chain = chain[: max(0, len(bits) - k * block)] & bits[k * block :]
                head = np.flatnonzero(chain)
                head = head[(head < block) | ~bits[head - block]]
                first = (head // block - 2 - slot) * block
                if len(head) and runs:
                    reach[:] = 0
                    for start, length, period in runs:
                        if period <= least * block:
                            reach[start] = max(reach[start], start + length)
                    np.maximum.accumulate(reach, out=reach)
                # by the periodicity lemma such a chain has that run's period, and ends where it ends
                inside = reach[first] >= head + least * block if len(head) else head
                for start, suffix in zip(first[~inside].tolist(), head[~inside].tolist(), strict=True) if len(head) else ():
                    end = suffix
                    while end < len(bits) and bits[end]:
                        end += block
                    take(suffix - start, start, start + end - suffix)
        return sorted(runs, key=lambda r: (r[0], r[2]))


def best_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the most periods; of equal ones that with the smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def repeated_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words some run holds behind its first period."""
    step = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return np.cumsum(step[:-1]) > 0


def words_runs(words: list[bytes], length: int, power: int) -> list[tuple[int, int, int]]:
    known: dict[bytes, int] = {}
    codes = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    catcher = SquareCatcher(length, power)
    catcher.append(codes)
    return catcher.runs()


def with_runs(
    docs: DataFrame, text: str = "text", length: int = LEAST_LENGTH, power: int = LEAST_POWER
) -> DataFrame:
    """``docs`` with ``runs``, ``best`` (the run with the most periods, null if none) and
    ``collapsed``: the words that no run holds behind its first period, joined by one space.

    A run is a stretch of words (without ASCII white space) with smallest period ``period``, of at
    least ``length`` words and ``power`` periods, that no neighbouring word extends. ``runs`` holds
    structs (start, length, period) by start, then period; overlapping runs are all there. A null
    or empty text has no words and no runs. Texts are read whole, one at a time and without a
    shuffle; a long one takes about 150 bytes a word. Every row is judged by its own text, so
    repeated rows get equal results. Columns of the added names are replaced, others stay.
    """
    added = ("runs", "best", "collapsed")
    others = [c for c in docs.columns if c.lower() not in added]
    row = F.struct(F.lit(1).alias("x"), *[column(c).alias(f"c{i}") for i, c in enumerate(others)])
    packed = docs.select(text_bytes(text).alias("text"), row.alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 0, STEP_BYTES):
                found, best, collapsed = [], [], []
                for body in piece.column(0).to_pylist():
                    words = body.split()
                    runs = words_runs(words, length, power)
                    top = best_run(runs)
                    if runs:
                        gone = repeated_words(len(words), runs)
                        words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
                    best.append(dict(zip(("start", "length", "period"), top, strict=True)) if top else None)
                    collapsed.append(b" ".join(words))
                one = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
                yield pa.record_batch(
                    [
                        piece.column(1), pa.array(found, pa.list_(one)), pa.array(best, one),
                        pa.array(collapsed, pa.binary()),
                    ],
                    names=["row", *added],
                )

    kind = packed.schema["row"].dataType.simpleString()
    done = packed.mapInArrow(run, f"row {kind}, runs {RUN_DDL}, best {RUN_DDL[6:-1]}, collapsed binary")
    return done.select(
        *[F.col("row").getField(f"c{i}").alias(c) for i, c in enumerate(others)],
        "runs", "best", F.col("collapsed").cast("string").alias("collapsed"),
    )
