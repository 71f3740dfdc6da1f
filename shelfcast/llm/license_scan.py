"""License notices by a positional index of rare words, in DataFrame functions alone.

A notice is a template: words, some of them mandatory key phrases. The inverse document frequency
of every template word is counted over all texts. A text is looked up by the two mandatory words
of each template that are rarest by that count: their places, less their places in the template,
are candidate starts, and the start that both propose is one at which they stand in the template's
relative position. There all mandatory words must match, and of the weight of all its words a given
share. Whatever has its mandatory phrases is found, so the index costs no result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import column, whole_text

#: What stands between words, once A-Z are in lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Part of a template's weight that must match.
LEAST_SHARE = 0.6
#: Phrases that are counted wherever they stand.
PHRASES = (
    ("mit", "[under the mit license]"),
    ("apache-2", "[apache license version 2]"),
    ("cc-by-nc", "[cc by nc]"),
)
#: Usual notices; mandatory phrases in brackets.
NOTICES = (
    ("agpl-3", "licensed under the [gnu affero general public license version 3]"),
    ("apache-2", "licensed under the [apache license version 2] 0"),
    ("apache-2", "you may obtain a copy of the license at http www [apache org licenses license 2] 0"),
    ("boost-1", "distributed under the [boost software license version 1] 0"),
    ("bsd", "[redistribution and use in source and binary forms] with or without modification are permitted"),
    ("cc-by", "licensed under [cc by 4] 0"),
    ("cc-by", "creative commons [attribution 4 0 international] license"),
    ("cc-by-nc", "licensed under [cc by nc] 4 0"),
    ("cc-by-nc", "creative commons [attribution noncommercial] 4 0 international license"),
    ("cc-by-sa", "licensed under [cc by sa] 4 0"),
    ("cc-by-sa", "creative commons [attribution sharealike] 4 0 international license"),
    ("cc0", "[cc0 1 0 universal] public domain dedication"),
    ("epl-2", "under the terms of the [eclipse public license 2] 0"),
    ("gpl-2", "under the terms of the [gnu general public license version 2]"),
    ("gpl-3", "licensed under the [gnu general public license version 3]"),
    ("isc", "[permission to use copy modify and or distribute this software] for any purpose"),
    ("lgpl-3", "licensed under the [gnu lesser general public license version 3]"),
    ("mit", "released under the [mit license]"),
    ("mit", "[permission is hereby granted free of charge] to any person obtaining a copy of this software"),
    ("mpl-2", "subject to the terms of the [mozilla public license v 2] 0"),
    ("unlicense", "this is [free and unencumbered software] released into the public domain"),
    ("zlib", "this software is provided [as is without any express or implied warranty]"),
)


@dataclass(frozen=True)
class Template:
    """A notice: its words, and the places among them that must match."""

    label: str
    words: tuple[str, ...]
    must: tuple[int, ...]
    phrase: bool

    @classmethod
    def of(cls, label: str, text: str, phrase: bool = False) -> Template:
        parts = re.split(r"([\[\]])", text)
        words, must, inside = [], [], False
        for part in parts:
            if part in ("[", "]"):
                inside = part == "["
                continue
            for word in part.split():
                if inside:
                    must.append(len(words))
                words.append(word)
        if len(must) < 2:
            raise ValueError(f"a template needs two mandatory words at least: {text!r}")
        return cls(label, tuple(words), tuple(must), phrase)


TEMPLATES = (*[Template.of(*p, phrase=True) for p in PHRASES], *[Template.of(*n) for n in NOTICES])


def words_of(text: Column) -> Column:
    """The words, A-Z in lower case. Lowering everything is faster than translating 26 letters; of
    all other letters only the Kelvin sign would become an ASCII one, so another stands in for it."""
    return F.array_remove(F.split(F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u2126"))), BETWEEN), "")


def word_weights(docs: DataFrame, words: Sequence[str], text: str = "text") -> dict[str, int]:
    """1 + floor(1000 ln((n + 1) / (n_word + 1))) for each of ``words``, over all texts.

    One row for each of ``words`` comes to the driver, whatever the number of texts.
    """
    some = F.lit(sorted(set(words)))
    # a text with none of them still counts, as one null
    found = docs.select(F.explode_outer(F.array_intersect(words_of(whole_text(text)), some)).alias("word"))
    counts = {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = docs.count()
    return {w: 1 + math.floor(1000 * math.log((n + 1) / (counts.get(w, 0) + 1))) for w in sorted(set(words))}


def _literal(templates: Sequence[Template], weights: dict[str, int]) -> Column:
    """The index: of each template its words, their weights, and its two rarest mandatory words."""
    rows = []
    for t in templates:
        one, two = sorted(t.must, key=lambda k: (-weights[t.words[k]], k))[:2]
        rows.append(
            F.struct(
                F.lit(t.label).alias("label"), F.lit(t.phrase).alias("phrase"),
                F.lit(list(t.words)).alias("words"), F.lit([weights[w] for w in t.words]).alias("weights"),
                F.lit(list(t.must)).alias("must"), F.lit(one).alias("one"), F.lit(two).alias("two"),
                F.lit(sorted({t.words[k] for k in t.must})).alias("needed"),
                F.lit(sum(weights[w] for w in t.words)).alias("whole"),
            )
        )
    return F.array(*rows)


def with_licenses(
    docs: DataFrame, text: str = "text", templates: Sequence[Template] = TEMPLATES, least: float = LEAST_SHARE
) -> DataFrame:
    """``docs`` with ``n_words`` and ``notices``: structs (label, phrase, at, share).

    Words are runs of digits, letters and characters beyond ASCII, A-Z in lower case. ``at`` is the
    word, from 0, at which a template starts (below 0 where a text begins inside it); ``share`` the
    part of its weight that matches, ``least`` or more. ``notices`` is ordered by template, then place.

    A null text counts as empty and has no words. Each row is scanned by itself: repeated rows get
    equal results, and nothing but the word counts is gathered. Texts are read whole; a long one
    takes about 60 bytes a word. Columns of the added names are replaced, others stay.
    """
    weights = word_weights(docs, [w for t in templates for w in t.words], text)
    index = _literal(templates, weights)
    needed = F.lit(sorted({t.words[k] for t in templates for k in t.must}))
    added = ("n_words", "notices")
    row = F.struct(F.lit(1).alias("x"), *[column(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    rows = docs.select(row.alias("row"), words_of(whole_text(text)).alias("words"))
    rows = rows.select("*", F.size("words").cast("long").alias("n_words"), F.array_intersect("words", needed).alias("has"))
    # a lambda computes anew whatever it names; a column that is named twice is computed once
    rows = rows.withColumn(
        "open",
        F.filter(
            F.when(F.size("has") > 1, index).otherwise(F.slice(index, 1, 0)),
            lambda t: F.size(F.array_except(t["needed"], F.col("has"))) == 0,
        ),
    )

    def probes(t: Column) -> Column:
        return F.array(F.get(t["words"], t["one"]), F.get(t["words"], t["two"]))

    rows = rows.withColumn("rare", F.array_distinct(F.flatten(F.transform("open", probes))))
    spots = F.filter(
        F.transform("words", lambda w, i: F.when(F.array_contains(F.col("rare"), w), F.struct(w.alias("word"), i.alias("at")))),
        lambda s: s.isNotNull(),
    )
    kind = "array<struct<word: string, at: int>>"
    rows = rows.withColumn("spots", F.when(F.size("rare") > 0, spots).otherwise(F.expr("array()").cast(kind)))

    def starts(t: Column, k: Column) -> Column:
        mine = F.filter("spots", lambda s: s["word"] == F.get(t["words"], k))
        return F.transform(mine, lambda s: s["at"] - k)

    def stands(t: Column, at: Column, k: Column) -> Column:
        # get gives null beyond the text, and before it
        return F.coalesce(F.get(F.col("words"), at + k) == F.get(t["words"], k), F.lit(False))

    def share(t: Column, at: Column) -> Column:
        def add(so_far: Column, k: Column) -> Column:
            return so_far + F.when(stands(t, at, k), F.get(t["weights"], k)).otherwise(0)

        every = F.sequence(F.lit(0), F.size(t["words"]) - 1)
        return F.aggregate(every, F.lit(0), add).cast("double") / t["whole"]

    def verified(t: Column) -> Column:
        both = F.array_sort(F.array_intersect(starts(t, t["one"]), starts(t, t["two"])))
        sure = F.filter(both, lambda at: F.forall(t["must"], lambda k: stands(t, at, k)))
        return F.transform(
            sure,
            lambda at: F.struct(
                t["label"].alias("label"), t["phrase"].alias("phrase"), at.cast("long").alias("at"),
                share(t, at).alias("share"),
            ),
        )

    found = F.filter(F.flatten(F.transform("open", verified)), lambda n: n["share"] >= least)
    return rows.select("row", "n_words", found.alias("notices")).select(
        *[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() not in added], *added
    )
