"""The registered query of each operator, with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import WORD, table, whole_text
from .conversation_trie import prefix_trie, regrafted, turn_sequences
from .edit_counts import edited_counts
from .html_content import main_text
from .lattice_lm import lattice_scores
from .license_scan import with_licenses
from .line_dedup import drop_repeated_lines
from .mixing import mix
from .ngram_join import near_duplicate_classes
from .periodic_runs import with_runs
from .robust_outliers import robust_quality
from .sentencepieces import encode_documents
from .spot_signatures import fingerprints_with_edit
from .toxicity import fit_toxicity, score_toxicity


def op1_robust_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and robust distances per language and source, for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return robust_quality(docs).drop("n_lines")


def op2_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marginal log probability of every text over all its segmentations."""
    return lattice_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose 5-word shingle sets have a Jaccard similarity of 0.8 or more."""
    return near_duplicate_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every text, and whether decoding gives the text back."""
    return encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by source: 150 % of all words at weights 5, 2, 1, repeating."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    taken = F.col("size") * F.size("draws")
    return mix(docs).select(
        "doc.doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"),
        F.col("draws.shard").alias("shards"),
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document, by a model of the labelled ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).drop("text")


def op7_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op8_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after three edits."""
    counted = edited_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    edited = F.sha2(F.col("edited_text"), 256).alias("edited_sha256")
    return counted.select("*", edited).drop("text", "edited_text")


def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spot-signature fingerprints of every text and of its edited text."""
    return fingerprints_with_edit(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more share lose all their occurrences."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_lines(docs, min_docs=10, keep="none").select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256")
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, each grafted onto the head of another of its five."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    c = F.col("conv_id")
    head = F.crc32(c.cast("string").cast("binary")) % 9
    return prefix_trie(regrafted(turn_sequences(rows), c - c % 5, head, 8))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs``, a text in ten with its later words replaced by repetitions of some of them.

    With h the CRC of the decimal doc_id, h % 10 = 0 and g = h div 10: each of the n words from
    a = g % n on becomes word a + (i - a) % p, where p = 1 + (n - a) div (3 + g % 8). A text
    without words stays, and so does one without a doc_id.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    planted = docs.withColumns(
        {"h": h, "words": F.when(h % 10 == 0, F.regexp_extract_all(whole_text(), F.lit(f"({WORD})"), F.lit(1)))}
    ).withColumn("n", F.size("words"))
    some = F.col("n") > 0
    planted = planted.withColumn("a", F.when(some, F.expr("(h div 10) % n")).cast("int")).withColumn(
        "p", F.when(some, F.expr("1 + (n - a) div (3 + (h div 10) % 8)")).cast("int")
    )
    moved = F.expr("transform(sequence(0, n - 1), i -> words[if(i < a, i, a + (i - a) % p)])")
    return planted.select("doc_id", F.when(some, F.array_join(moved, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal runs of at least 24 words and three periods of every text, and what is left of it."""
    docs = with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.col("best")
    return with_runs(docs).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every text."""
    found = with_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = found.withColumn("base", F.filter("notices", lambda n: n["phrase"]))

    def labels(notices: str) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(notices, lambda n: n["label"]))), ",")

    at = F.transform("base", lambda n: n["at"])
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        labels("base").alias("base_labels"), labels("notices").alias("labels"),
        F.coalesce(F.array_max(F.transform("notices", lambda n: n["share"])), F.lit(0.0)).alias("score"),
    )


QUERIES = {
    "op1_robust_quality": op1_robust_quality,
    "op2_subword_lattice": op2_subword_lattice,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_mixing": op5_mixing,
    "op6_toxicity": op6_toxicity,
    "op7_tag_paths": op7_tag_paths,
    "op8_edit_counts": op8_edit_counts,
    "op9_spotsigs": op9_spotsigs,
    "op10_line_dedup": op10_line_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_license_scan": op13_license_scan,
}
