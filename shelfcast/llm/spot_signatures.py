"""Spot signatures: chains of content words behind common words, as a document's fingerprint.

DataFrame functions only. A spot is a common word (an anchor) with the content words behind it;
further anchors on the way belong to the chain of the first content word. The text is rewritten
once so that anchors hang on to the content word that follows, then split, and each word that
carries anchors opens a chain.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.ranges import range_bucket, range_cuts
from .common import WORD, ascii_lower, column, whole_text

#: Frequent function words of English, German, French and Spanish.
ANCHORS = (
    "a", "al", "an", "and", "are", "as", "at", "au", "auf", "be", "by", "con", "dans", "das", "de",
    "del", "dem", "den", "der", "des", "die", "du", "ein", "eine", "el", "en", "es", "est", "et",
    "for", "from", "für", "il", "in", "is", "ist", "it", "la", "las", "le", "les", "los", "mit",
    "nicht", "no", "of", "on", "or", "para", "por", "pour", "que", "qui", "se", "sich", "sur",
    "that", "the", "this", "to", "un", "una", "und", "une", "von", "was", "with", "y", "zu",
)
#: Content words of a chain.
CHAIN = 3
_BLANK = WORD.replace("^", "", 1)  # runs of white space
_MARK = "\u0001"
#: Hexadecimal digits of a signature.
DIGITS = 12


def with_signatures(
    df: DataFrame, text: str, name: str, anchors: Sequence[str] = ANCHORS, chain: int = CHAIN
) -> DataFrame:
    """``df`` with ``name``: the sorted distinct signatures of a text, as numbers of 48 bits.

    A signature is the hash of the anchors, their first content word and the ``chain - 1`` content
    words after it (fewer at the end). An anchor that ends the text counts as a content word. A text
    without any spot, the empty one too, has the hash of the whole text as its only signature, so
    that two such texts are alike only when they are equal. Never empty.
    """
    blank = _BLANK
    plain = F.translate(ascii_lower(F.col(text)), _MARK, "\u0002")
    plain = F.regexp_replace(plain, f"^{blank}|{blank}$", "")
    not_blank = f"[^{blank[1:-2]}]"
    fused = F.regexp_replace(plain, f"(?<!{not_blank})({'|'.join(anchors)}){blank}", f"$1{_MARK}")

    def behind(word: Column) -> Column:
        return F.substring_index(word, _MARK, -1)

    def open_chain(word: Column, at: Column) -> Column:
        rest = [behind(F.get(F.col("__words"), at + k)) for k in range(1, chain)]
        return F.when(F.contains(word, F.lit(_MARK)), F.concat_ws(" ", word, *rest))

    def number(value: Column) -> Column:
        return F.conv(F.substring(F.md5(value), 1, DIGITS), 16, 10).cast("long")

    # each step is a column of its own, as a lambda computes anew whatever it names
    spots = F.filter(F.transform("__words", open_chain), lambda c: c.isNotNull())
    hashed = F.sort_array(F.array_distinct(F.transform("__spots", number)))
    return (
        df.withColumn("__words", F.split(fused, blank))
        .withColumn("__spots", spots)
        .withColumn(name, F.when(F.size("__spots") > 0, hashed).otherwise(F.array(number(F.col(text)))))
        .drop("__words", "__spots")
    )


def fingerprint(spots: Column) -> Column:
    """The signatures as one string of hexadecimal digits, ``DIGITS`` for each."""
    return F.array_join(
        F.transform(spots, lambda s: F.lpad(F.lower(F.hex(s)), DIGITS, "0")), ""
    )


def length_partition(spots: Column, at_least: float) -> Column:
    """Sets with a Jaccard likeness of ``at_least`` lie in one partition or in neighbouring ones."""
    return F.floor(F.log(F.size(spots).cast("double")) / -F.log(F.lit(at_least)) + F.lit(1e-9))


def likeness(a: Column, b: Column, at_least: float = 0.0) -> Column:
    """Jaccard likeness of two signature sets; 0 where their lengths alone keep it below ``at_least``."""
    common = F.size(F.array_intersect(a, b))
    value = common / (F.size(a) + F.size(b) - common)
    if at_least <= 0:
        return value
    apart = F.abs(length_partition(a, at_least) - length_partition(b, at_least)) > 1
    bound = F.least(F.size(a), F.size(b)) / F.greatest(F.size(a), F.size(b))
    return F.when(apart | (bound < at_least), F.lit(0.0)).otherwise(value)


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, text, spots, next_text, next_spots)``: each row's signatures, and those and the text of
    the next row by descending key (null last, then by text), cyclic.

    The keys are cut into ranges, about two for each shuffle partition; a window runs inside a
    range, and a copy of the next range's first row closes it. Only the first row of each range
    passes through a global window.
    """
    spark = docs.sparkSession
    rows = docs.select(column(key).alias("key"), whole_text(text).alias("text"))
    cuts = range_cuts(rows, "key", 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    bucket = F.coalesce(range_bucket("key", cuts), F.lit(-1))
    order = F.struct("key", F.md5("text").alias("digest"))
    rows = rows.select(bucket.alias("bucket"), order.alias("order"), "key", "text")
    heads = rows.groupBy("bucket").agg(F.max("order").alias("order"))
    down = Window.orderBy(F.desc("bucket"))
    everything = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    closing = heads.select(
        F.col("bucket").alias("closes"),
        F.coalesce(F.lead("order").over(down), F.first("order").over(everything)).alias("wanted"),
    )
    # one row for each range, at most two for each shuffle partition: small enough to send around
    picked = rows.join(F.broadcast(closing), F.col("order").eqNullSafe(F.col("wanted")))
    # rows equal in key and text close a range once
    ghosts = picked.groupBy(F.col("closes").alias("bucket")).agg(F.first("text").alias("text")).select(
        "bucket", F.lit(None).cast(rows.schema["order"].dataType).alias("order"),
        F.lit(None).cast(rows.schema["key"].dataType).alias("key"), "text", F.lit(True).alias("ghost"),
    )
    both = with_signatures(rows.withColumn("ghost", F.lit(False)).unionByName(ghosts), "text", "spots")
    inside = Window.partitionBy("bucket").orderBy("ghost", F.desc("order"))
    return (
        both.withColumn("next_text", F.lead("text").over(inside))
        .withColumn("next_spots", F.lead("spots").over(inside))
        .where(~F.col("ghost"))
        .select("key", "text", "spots", "next_text", "next_spots")
    )


def fingerprints_with_edit(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and how near they are.

    Edited text: the second half (``floor(n / 2)`` code points) replaced by the first as many of
    the next document's. Returns key, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. A null text counts as empty; the edited text of an empty one is empty,
    near_edited is then 1. Rows with equal keys follow each other by text. With one row, the next
    document is the document itself. An empty table gives an empty result.
    """
    rows = with_next(docs, key, text)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.select(
        "key", n.cast("long").alias("n_chars"), "spots", "next_spots",
        F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited"),
    )
    rows = with_signatures(rows, "edited", "edited_spots")
    return rows.select(
        F.col("key").alias(key), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("spots")).alias("fingerprint"),
        fingerprint(F.col("edited_spots")).alias("edited_fingerprint"),
        likeness(F.col("spots"), F.col("edited_spots")).alias("near_edited"),
        likeness(F.col("spots"), F.col("next_spots")).alias("near_next"),
    )
