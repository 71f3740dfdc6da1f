"""Cleans and mixes the documents, one operator per stage: toxicity, shared lines, near duplicates,
mixing, encoding. Each stage works on all rows that the one before it kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfcast.llm.common import BATCH_BYTES, BATCH_LIMIT, shared_folder, written
from shelfcast.llm.line_dedup import drop_repeated_lines
from shelfcast.llm.mixing import dealt, mix
from shelfcast.llm.ngram_join import near_duplicate_classes
from shelfcast.llm.sentencepieces import encode_documents
from shelfcast.llm.toxicity import fit_toxicity, score_toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Columns that the stages read; whatever else a document has is carried along under another name.
READ = ("doc_id", "text", "lang", "source", "n_chars")


def carrying(stage: Stage) -> Stage:
    """``stage`` with all further columns of the documents kept as they are, whatever their names.

    Operators add columns of their own and replace those of the same names; here further columns
    have other names inside a stage and get their own back behind it. Only the last stage's results
    replace columns of their names.

    A stage's result is computed when its caller writes it, so the session's limit on what Python
    gets at a time stays at ``BATCH_BYTES``: memory that one stage's large buffers took outside the
    heap stays with the executor in the stages behind it.
    """

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(BATCH_LIMIT, BATCH_BYTES)
        inner = {c: c if c in READ else f"carried__{i}" for i, c in enumerate(docs.columns)}
        out = stage(spark, docs.toDF(*inner.values()), sf_dir)
        back = {name: c for c, name in inner.items()}
        added = {c.lower() for c in out.columns if c not in back}
        kept = [c for c in out.columns if c in READ or back.get(c, "").lower() not in added]
        return out.select(*kept).toDF(*[back.get(c, c) for c in kept])

    return run


@carrying
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go; the model is fitted on the labelled ones. A null or empty text is clean,
    repeated rows are judged alike, a very long text is read whole; no documents: none."""
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).where(~F.col("toxic")).select(*docs.columns)


@carrying
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more share go; n_chars follows the text. Documents stay. Every row
    counts as a document, repeated ones too; a null text becomes an empty one."""
    kept = drop_repeated_lines(docs, min_docs=10, keep="none")
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


@carrying
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class stays, that with the least doc_id; rows without words, or with a null
    doc_id, stay.

    A document is a doc_id with a text: rows that share a doc_id but not the text are judged one by
    one (in a class the least 64-bit digest stays), of rows equal in both the least in all columns.
    """
    own = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", F.xxhash64("text").alias("digest")))
    named = docs.withColumn("own", own)
    classes = near_duplicate_classes(named.select("own", "text"), key="own")
    with_words = classes.where(F.col("own").isNotNull() & (F.col("n_shingles") > 0))
    times = with_words.groupBy("own", "component_id").agg(F.count(F.lit(1)).alias("times"))
    marks = times.select("own", (F.col("component_id") < F.col("own")).alias("gone"), "times")
    marks = written(marks.where("gone or times > 1"), "marks")
    plain = named.join(marks, "own", "left_anti").select(*docs.columns)
    repeated = named.join(marks.where("not gone").select("own"), "own")
    # combined before its shuffle, so a row repeated very often arrives once per task
    single = repeated.groupBy("own").agg(F.min(F.struct(*docs.columns)).alias("doc"))
    return plain.unionByName(single.select("doc.*"))


@carrying
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources, a row for each time that a document is drawn, shuffled by shard. Rows equal
    in doc_id and text are drawn as often as each other; a null source is a source; a document
    without words is drawn like any other."""
    return dealt(mix(docs)).select(*docs.columns)


@carrying
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of every drawn document; none for a null or empty text. Every row is encoded by
    itself and whole."""
    return encode_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixing),
    ("SentencePiece encoding", encoding),
]
#: Toxicity, mixing and encoding rest on a fitted model, seeded hashes and a vocabulary file, which
#: SQL can't express; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each stage's result is written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
