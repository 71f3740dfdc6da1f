"""What a task holds at a time does not grow with its partition, and filters go when their step is written."""

import collections
import re

import pyarrow as pa
import pytest
from pyspark import SparkContext
from pyspark.sql import functions as F

import corpus_pipeline
from shelfcast.llm.common import BATCH_LIMIT, written
from shelfcast.llm.lattice_lm import BLOCK_BYTES, ROW_BYTES, _blocks
from shelfcast.llm.mixing import dealt, mix
from shelfcast.llm.ngram_join import jaccard_links, near_duplicate_classes


@pytest.fixture
def limit(spark):
    before = spark.conf.get(BATCH_LIMIT)
    spark.conf.set(BATCH_LIMIT, "50000000")
    yield "50000000"
    spark.conf.set(BATCH_LIMIT, before)


@pytest.fixture
def large(spark):
    """24 MB in one partition."""
    return spark.range(0, 3000, 1, 1).select(F.expr("repeat('x', 8000)").alias("text"))


def measured(df):
    def run(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes]), pa.array([batch.num_rows])], names=["size", "n"])

    return df.mapInArrow(run, "size long, n long")


def test_written_hands_python_small_batches(spark, large, limit):
    got = written(measured(large), "sizes").collect()
    assert sum(r["n"] for r in got) == 3000
    assert max(r["size"] for r in got) < 5_000_000
    assert spark.conf.get(BATCH_LIMIT) == limit
    with pytest.raises(Exception, match="failed here"):
        written(large.select(F.raise_error(F.lit("failed here")).alias("x")), "nothing")
    assert spark.conf.get(BATCH_LIMIT) == limit


def test_stages_hand_python_small_batches(spark, large, limit):
    stage = corpus_pipeline.carrying(lambda spark, docs, sf_dir: measured(docs))
    # computed by the caller, when the stage's function has returned
    got = stage(spark, large, "").collect()
    assert sum(r["n"] for r in got) == 3000
    assert max(r["size"] for r in got) < 5_000_000


def test_filters_are_gone_when_their_step_is_written(spark, monkeypatch):
    made = []
    plain = SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: made.append(plain(self, value)) or made[-1])
    near = " ".join(f"w{i}" for i in range(100))
    texts = [(1, near), (2, near + " end"), (3, "some other words that stand alone here"), (4, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    classes = near_duplicate_classes(docs)
    members, links = jaccard_links(docs)
    assert len(made) >= 6
    for filter_ in made:
        with pytest.raises(Exception, match="destroyed"):
            filter_.unpersist()
    assert {r["doc_id"]: r["component_id"] for r in classes.collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert links.count() == 1 and members.count() == 4


def test_draws_of_a_document_are_computed_once(spark):
    rows = [(i, f"w{i} " * (i % 9), "ab"[i % 2]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mix(docs, share=0.5, shards=4)
    out = dealt(mixed, 4)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # the search among a source's cuts stands once, and compares them with places that are already there
    searches = re.findall(r"filter\(cuts#\d+, lambdafunction\(\(lambda \w+#\d+L? <= (\S+)", plan)
    assert searches == ["lambda"]
    drawn = {r["doc"]["doc_id"]: len(r["draws"]) for r in mixed.collect()}
    got = collections.Counter(r["doc_id"] for r in out.collect())
    assert got == +collections.Counter(drawn) and 0 in drawn.values()


def test_blocks_gather_small_batches(spark, large):
    docs = large.select(F.monotonically_increasing_id().alias("doc_id"), "text")
    blocks = written(_blocks(docs, "doc_id", "text"), "blocks").collect()
    sizes, full = [len(r["docs"]) for r in blocks], BLOCK_BYTES // (8000 + ROW_BYTES)
    # batches hold 4 MB
    assert sorted(sizes, reverse=True) == [full] * (3000 // full) + [3000 % full]
    assert len({r["block"] for r in blocks}) == len(blocks)
    assert sorted(d["key"] for r in blocks for d in r["docs"]) == list(range(3000))
    assert all(r["words"] == [b"x" * 8000] and len(r["ids"]) == 4 * n for r, n in zip(blocks, sizes, strict=True))
