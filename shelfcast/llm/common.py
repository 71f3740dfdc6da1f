"""What the operators share: words, whole texts as bytes, shared scratch tables, stable hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word, for Java's regular expressions: a run without space, tab or line-breaking characters.
#: ``bytes.split()`` cuts at the same six characters and ``bytes.lower()`` touches A-Z alone.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one Python step works on at a time; a longer text is a step of its own.
STEP_BYTES = 4_000_000
#: Bytes of rows that Spark hands to Python at a time while a table is written. Spark's own limit is 64 MB,
#: which a task holds several times over: growing buffers outside the JVM's heap, and Python's copy.
BATCH_BYTES, BATCH_LIMIT = "4m", "spark.sql.execution.arrow.maxBytesPerBatch"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def column(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(column(name).cast("string"), F.lit(""))


def text_bytes(name: str = "text") -> Column:
    return whole_text(name).cast("binary")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def n_words(name: str = "text") -> Column:
    return F.regexp_count(whole_text(name), F.lit(WORD)).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local session where none is set (tests) gets one.

    On a cluster a folder of one machine would be another on each, so there it must be set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="shelfcast-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside hand Python ``BATCH_BYTES`` at a time; the session's limit comes back."""
    before = spark.conf.get(BATCH_LIMIT)
    spark.conf.set(BATCH_LIMIT, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(BATCH_LIMIT, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later steps neither recompute it nor
    depend on the executors that made it."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{shared_folder(spark)}/shelfcast-{app}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pieces(batch: pa.RecordBatch, text: int, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in row ranges of about ``most`` bytes of its column number ``text``."""
    sizes = np.diff(
        np.frombuffer(batch.column(text).buffers()[1], np.int32, batch.num_rows + 1,
                      4 * batch.column(text).offset)
    ) if pa.types.is_binary(batch.schema.field(text).type) else np.array(
        [len(v.as_buffer()) for v in batch.column(text)], np.int64
    )
    begin, held = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if row > begin and held + size > most:
            yield batch.slice(begin, row - begin)
            begin, held = row, 0
        held += size
    if begin < batch.num_rows:
        yield batch.slice(begin)


def by_piece(
    work: Callable[[pa.RecordBatch], pa.RecordBatch], text: int = 0, most: int = STEP_BYTES
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` as a function for ``mapInArrow``, given bounded row ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text, most):
                yield work(piece)

    return run


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64's), so that every bit of a hash depends on every other."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
