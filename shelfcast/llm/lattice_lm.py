"""Document probability under a unigram subword model, summed over all segmentations.

No piece of the vocabulary reaches over the start of a word, so a document's lattice falls apart
into its words' lattices: the log probability of the text is the sum over its words, each by a
log-space forward recursion, and of the end. Distinct words are gathered over all documents and
scored once; documents then collect their words' scores.

The vocabulary and its first scores are a file's. The scores are re-estimated on the training
documents by expectation maximisation, over distinct words with their counts. The vocabulary itself
is never changed.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import column, pieces, text_bytes, written
from .lattice import MARK, Trie, expected_counts, marginals
from .pieces_file import MODEL, read_pieces

#: Rounds of re-estimation, and the part of a count that every piece has in advance.
ROUNDS, PRIOR = 2, 0.1
FOLDS, HELD_OUT = 7, 2
#: Bytes of text whose documents share one block, within which a word is sent once, and what a document
#: counts besides its text. A block gathers as many batches as it takes, so that smaller batches do not
#: make more blocks, each of which sends its own copy of the common words.
BLOCK_BYTES, ROW_BYTES = 10_000_000, 100


class _Block:
    """Documents of one block: their words as numbers with counts, and the distinct words."""

    def __init__(self) -> None:
        self.size, self.docs = 0, []
        self.index: dict[bytes, int] = {}
        self.train: list[int] = []
        self.ids, self.counts = array("i"), array("i")

    def add(self, key: object, text: bytes, held_out: bool) -> None:
        found = Counter(text.lower().split())
        index, train = self.index, self.train
        for word in found:
            if word not in index:
                index[word] = len(index)
                train.append(0)
        mine = [index[w] for w in found]
        self.ids.extend(mine)
        self.counts.extend(found.values())
        if not held_out:
            for at, n in zip(mine, found.values(), strict=True):
                train[at] += n
        self.docs.append(
            {"key": key, "held_out": held_out, "n_distinct": len(mine), "n_words": sum(found.values())}
        )
        self.size += len(text) + ROW_BYTES

    def row(self, number: int, kind: pa.DataType) -> pa.RecordBatch:
        return pa.record_batch(
            [
                pa.array([number], pa.int64()),
                pa.array([self.docs], kind),
                pa.array([self.ids.tobytes()], pa.binary()),
                pa.array([self.counts.tobytes()], pa.binary()),
                pa.array([list(self.index)], pa.list_(pa.binary())),
                pa.array([self.train], pa.list_(pa.int64())),
            ],
            names=["block", "docs", "ids", "counts", "words", "train"],
        )


def _blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per block: its documents, the words of each as numbers with counts, and its distinct
    words with their counts in training documents."""
    fold = F.pmod(F.crc32(column(key).cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT
    rows = docs.select(
        text_bytes(text).alias("text"), column(key).alias("key"),
        F.coalesce(fold, F.lit(False)).alias("held_out"),
    )
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        block = _Block()
        for batch in batches:
            for piece in pieces(batch, 0):
                held = piece.column(2).to_pylist()
                for key_, data, out in zip(piece.column(1).to_pylist(), piece.column(0).to_pylist(), held, strict=True):
                    if block.docs and block.size + len(data) + ROW_BYTES > BLOCK_BYTES:
                        yield block.row(part, batch_docs)
                        part, block = part + 1, _Block()
                    block.add(key_, data, out)
        if block.docs:
            yield block.row(part, batch_docs)

    batch_docs = pa.list_(
        pa.struct([
            ("key", _arrow_type(rows)), ("held_out", pa.bool_()),
            ("n_distinct", pa.int64()), ("n_words", pa.int64()),
        ])
    )
    return rows.mapInArrow(
        run,
        f"block long, docs array<struct<key:{kind},held_out:boolean,n_distinct:long,n_words:long>>, "
        "ids binary, counts binary, words array<binary>, train array<long>",
    )


def _arrow_type(rows: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema["key"].dataType)


def fit_scores(words: DataFrame, ends: int, path: str) -> tuple[Trie, np.ndarray, np.ndarray, float]:
    """The trie, natural log scores of pieces and of bytes, and of the end of a document.

    ``words`` has (word, c). Each round is one pass over the distinct words; what a task sends are
    its sums for each piece of the vocabulary.
    """
    known = read_pieces(path)
    names = list(known.normal)
    trie = Trie.of({p: i for i, p in enumerate(names)})
    n = len(names)
    scores = known.scores[[known.normal[p] for p in names]]
    bytes_ = np.full(256, scores.min() - np.log(256))
    context = words.sparkSession.sparkContext
    end = 0.0
    for _ in range(ROUNDS):
        shared = context.broadcast((trie.plain, scores, bytes_))

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            parts, scores_, bytes__ = shared.value
            trie_ = Trie(*parts)
            total = np.zeros(n + 256)
            for batch in batches:
                for begin in range(0, batch.num_rows, 20_000):
                    part = batch.slice(begin, 20_000)
                    marked = [MARK + w for w in part.column(0).to_pylist()]
                    total += expected_counts(trie_, scores_, bytes__, marked, part.column(1).to_numpy().astype(float), n)
            some = np.flatnonzero(total > 0)
            yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["piece", "n"])

        sums = (
            words.where("c > 0").select("word", "c").mapInArrow(expect, "piece long, n double")
            .groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        )
        counts = np.full(n + 256, PRIOR)
        counts[sums["piece"].to_numpy(np.int64)] += sums["n"].to_numpy(float)
        whole = counts.sum() + ends + PRIOR
        scores, bytes_ = np.log(counts[:n] / whole), np.log(counts[n:] / whole)
        end = float(np.log((ends + PRIOR) / whole))
    return trie, scores, bytes_, end


def lattice_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = MODEL) -> DataFrame:
    """Base and lattice log10 probabilities of every row.

    Returns key, held_out, n_tokens, n_known, train_tokens, base_score, score. A-Z is lower-cased;
    tokens are the words and one end. Rows whose crc32 of the key as text leaves 2 modulo 7 are held
    out, all others (a null key too) are learnt from. A null or empty text has the end as its only
    token. Every row counts as a document. A character outside the vocabulary falls back to its bytes.
    An empty table gives an empty result; without training rows no token is known, and the model
    keeps the file's scores but for the prior.
    """
    spark = docs.sparkSession
    blocks = written(_blocks(docs, key, text), "blocks")
    pairs = blocks.select("block", F.posexplode(F.arrays_zip("words", "train"))).select(
        "block", F.col("pos").alias("at"), F.col("col.words").alias("word"), F.col("col.train").alias("c")
    )
    words = written(pairs.groupBy("word").agg(F.sum("c").alias("c")), "words")
    seen = words.where("c > 0").agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n")).first()
    ends = blocks.select(F.explode("docs").alias("d")).where(~F.col("d.held_out")).count()
    distinct = seen["v"] + (ends > 0)
    tokens = (seen["n"] or 0) + ends
    trie, scores, bytes_, end = fit_scores(words, ends, path)
    shared = spark.sparkContext.broadcast((trie.plain, scores, bytes_))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, scores_, bytes__ = shared.value
        trie_ = Trie(*parts)
        for batch in batches:
            for begin in range(0, batch.num_rows, 20_000):
                part = batch.slice(begin, 20_000)
                marked = [MARK + w for w in part.column(0).to_pylist()]
                yield pa.record_batch(
                    [*part.columns, pa.array(marginals(trie_, scores_, bytes__, marked))],
                    names=["word", "c", "logp"],
                )

    scored = words.mapInArrow(score, "word binary, c long, logp double")
    back = pairs.select("block", "at", "word").join(scored, "word").groupBy("block").agg(
        F.collect_list(F.struct("at", "c", "logp")).alias("found")
    )
    divisor = np.log10(tokens + (distinct + 1))
    end_base = float(np.log10(ends + 1) - divisor)
    log10e = float(np.log10(np.e))
    kind = blocks.schema["docs"].dataType.elementType["key"].dataType.simpleString()
    key_type = _arrow_type(docs.select(column(key).alias("key")))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                documents = batch.column(0)[row].as_py()
                ids = np.frombuffer(batch.column(1)[row].as_py(), np.int32)
                times = np.frombuffer(batch.column(2)[row].as_py(), np.int32).astype(np.int64)
                c, logp = np.zeros(0, np.int64), np.zeros(0)
                if batch.column(3)[row].is_valid:
                    found = batch.column(3)[row].values.flatten()
                    at = found[0].to_numpy()
                    c, logp = np.zeros(len(at), np.int64), np.zeros(len(at))
                    c[at], logp[at] = found[1].to_numpy(), found[2].to_numpy()
                owner = np.repeat(np.arange(len(documents)), [d["n_distinct"] for d in documents])
                size = len(documents)
                total = lambda v: np.bincount(owner, v, size)
                known = total(times * (c[ids] > 0)).astype(np.int64) + (ends > 0)
                base = total(times * (np.log10(c[ids] + 1) - divisor)) + end_base
                full = (total(times * logp[ids]) + end) * log10e
                yield pa.record_batch(
                    [
                        pa.array([d["key"] for d in documents], key_type),
                        pa.array([d["held_out"] for d in documents], pa.bool_()),
                        pa.array([d["n_words"] + 1 for d in documents], pa.int64()),
                        pa.array(known, pa.int64()), pa.array([tokens] * size, pa.int64()),
                        pa.array(base), pa.array(full),
                    ],
                    names=["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    whole = blocks.select("block", "docs", "ids", "counts").join(back, "block", "left")
    return whole.select("docs", "ids", "counts", "found").mapInArrow(
        collect,
        f"key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double",
    ).withColumnRenamed("key", key)
