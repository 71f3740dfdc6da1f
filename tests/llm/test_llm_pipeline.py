"""The pipeline's stages leave further columns of the documents alone, whatever their names."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF_DIR = "/root/testdata/sf0.001"
NAMES = ["own", "n_lines", "toxic", "severity", "n_dropped", "doc", "ids", "draws", "a b", "x.y", "gone"]


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")
def test_clashing_columns_come_through(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    docs = docs.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in NAMES])
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs = stage(spark, docs, SF_DIR)
        last = name == corpus_pipeline.STAGES[-1][0]
        kept = [n for n in NAMES if not (last and n == "ids")]
        if last:
            assert docs.columns == [c for c in before if c != "ids"] + ["ids", "n_pieces", "n_byte_pieces", "round_trip"]
        else:
            assert docs.columns == before
        wrong = " or ".join(f"not (`{n}` <=> concat('{n}', doc_id))" for n in kept)
        assert docs.count() > 100 and docs.where(wrong).count() == 0
