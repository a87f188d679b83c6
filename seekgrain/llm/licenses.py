"""Licence scans with a positional rare-token index.

Templates are key phrases at word positions. The index lists, for every word of them, its places in the
templates. Words are weighed by their inverse document frequency over all texts, and each key phrase is
looked up by its highest-IDF word: every occurrence of it in a file gives the places where the phrase
would start. Postings that agree on where a template starts in the file are intersected, and the mandatory
key phrases are compared word by word. Everything is one row's own expression, so nothing is shuffled
but the counts of the licence words.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words; A-Z are letters here and are lowered word by word.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Copies of a template may move its key phrases apart by about this many words.
SLACK = 16


@dataclass(frozen=True)
class Template:
    """A licence notice: mandatory key phrases and the word positions at which they start."""

    label: str
    phrases: tuple[tuple[int, str], ...]


def notice(label: str, *phrases: tuple[int, str]) -> Template:
    return Template(label, phrases)


# The labelled phrases whose places are counted.
BASE = (
    notice("cc-by", (0, "cc by")),
    notice("gpl", (0, "general public license")),
    notice("reserved", (0, "all rights reserved")),
)
#: Notices of common public licences: short mentions, and the key phrases of their texts.
MORE = (
    notice("apache-2.0", (0, "apache license version 2 0")),
    notice("mit", (0, "mit license")),
    notice(
        "mit",
        (0, "permission is hereby granted free of charge to any person obtaining a copy"),
        (53, "the above copyright notice and this permission notice shall be included"),
        (71, "the software is provided as is without warranty of any kind"),
    ),
    notice("bsd", (0, "bsd license")),
    notice(
        "bsd",
        (0, "redistribution and use in source and binary forms with or without modification are permitted"),
        (24, "redistributions of source code must retain the above copyright notice"),
    ),
    notice("isc", (0, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted")),
    notice("lgpl", (0, "lesser general public license")),
    notice("agpl", (0, "affero general public license")),
    notice("mpl", (0, "mozilla public license")),
    notice("epl", (0, "eclipse public license")),
    notice("unlicense", (0, "this is free and unencumbered software released into the public domain")),
    notice("cc0", (0, "cc0 1 0 universal")),
    notice("cc-by-nc", (0, "cc by nc")),
    notice("cc-by-sa", (0, "cc by sa")),
    notice("cc-by-nd", (0, "cc by nd")),
    notice("cc-by", (0, "creative commons attribution")),
)
TEMPLATES = (*BASE, *MORE)


def words_of(text: Column) -> Column:
    """Runs of digits, letters and signs beyond ASCII; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def lowered(word: Column) -> Column:
    """The word with A-Z lowered, as far as it is ASCII: only such words can equal a licence word."""
    small = F.lower(word)
    return F.when(F.octet_length(small) == F.octet_length(word), small).otherwise(word)


def vocabulary(templates: tuple[Template, ...]) -> list[str]:
    return sorted({w for t in templates for _, phrase in t.phrases for w in phrase.split()})


def word_weights(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text: str = "text") -> dict[str, float]:
    """Inverse document frequency of every licence word over all rows, 1 at least; an empty table gives 1 to each.

    A row per licence word reaches the driver.
    """
    listed = vocabulary(templates)
    # The words are bound by a lambda, so that they are split once.
    found = F.transform(
        F.array(words_of(F.col(text))), lambda ws: F.array_distinct(F.transform(F.filter(ws, lambda w: F.lower(w).isin(listed)), lowered))
    )[0]
    n = docs.count()
    counts = docs.select(F.explode(found).alias("word")).groupBy("word").count().collect()
    many = {r["word"]: r["count"] for r in counts}
    return {w: round(math.log((n + 1.0) / (many.get(w, 0) + 1.0)) + 1, 6) for w in listed}


def rarest(phrase: str, weights: dict[str, float]) -> tuple[str, int]:
    """(word, offset): the highest-IDF word of a phrase, ties by the first, and where it stands."""
    words = phrase.split()
    at = max(range(len(words)), key=lambda i: (weights[words[i]], -i))
    return words[at], at


def shares(template: Template, weights: dict[str, float]) -> list[int]:
    """Millionths of the weight of a template that each of its phrases holds."""
    sums = [sum(weights[w] for w in phrase.split()) for _, phrase in template.phrases]
    return [round(1e6 * s / sum(sums)) for s in sums]


def _places(ws: Column, templates: tuple[Template, ...], weights: dict[str, float]) -> Column:
    """array<struct<template, phrase, start>> of the key phrases in the words ``ws``, by start."""
    index: dict[str, list[Column]] = {}
    for t, template in enumerate(templates):
        for p, (_, phrase) in enumerate(template.phrases):
            word, offset = rarest(phrase, weights)
            wanted = F.array(*map(F.lit, phrase.split()))
            posting = F.struct(
                F.lit(t).alias("template"), F.lit(p).alias("phrase"), F.lit(offset).alias("offset"), wanted.alias("words")
            )
            index.setdefault(word, []).append(posting)
    postings = F.create_map(*[c for word, listed in index.items() for c in (F.lit(word), F.array(*listed))])
    marked = F.transform(ws, lambda w, i: F.when(F.lower(w).isin(list(index)), i))
    occurrences = F.filter(marked, lambda i: i.isNotNull())

    def here(i: Column) -> Column:
        def holds(posting: Column) -> Column:
            start = i - posting["offset"]
            own = F.slice(ws, F.greatest(start, F.lit(0)) + 1, F.size(posting["words"]))
            return (start >= 0) & (F.transform(own, lowered) == posting["words"])

        listed = F.filter(F.element_at(postings, F.lower(F.get(ws, i))), holds)
        return F.transform(
            listed,
            lambda p: F.struct((i - p["offset"]).alias("start"), p["template"].alias("template"), p["phrase"].alias("phrase")),
        )

    return F.array_sort(F.flatten(F.transform(occurrences, here)))


def _verdict(places: Column, t: int, template: Template, weights: dict[str, float]) -> Column:
    """struct<label, millionths>: the label where all key phrases stand in position, and the weight found."""

    def starts(p: int, position: int) -> Column:
        mine = F.filter(places, lambda s: (s["template"] == t) & (s["phrase"] == p))
        return F.array_distinct(F.transform(mine, lambda s: F.floor((s["start"] - position) / SLACK).cast("long")))

    if len(template.phrases) == 1:
        found = F.exists(places, lambda s: s["template"] == t)
        return F.struct(F.when(found, F.lit(template.label)).alias("label"), F.when(found, 1_000_000).otherwise(0).cast("long").alias("millionths"))
    buckets = [starts(p, position) for p, (position, _) in enumerate(template.phrases)]
    near = buckets[0]
    for other in buckets[1:]:
        near = F.array_intersect(near, F.flatten(F.transform(other, lambda b: F.array(b - 1, b, b + 1))))
    aligned = F.size(near) > 0
    part = F.lit(0)
    for bucket, share in zip(buckets, shares(template, weights)):
        part = part + F.when(F.size(bucket) > 0, share).otherwise(0)
    return F.struct(
        F.when(aligned, F.lit(template.label)).alias("label"),
        F.when(aligned, 1_000_000).otherwise(F.floor(part / 2)).cast("long").alias("millionths"),
    )


def scan(
    docs: DataFrame, weights: dict[str, float], templates: tuple[Template, ...] = TEMPLATES, text: str = "text", result: str = "licences"
) -> DataFrame:
    """``docs`` with struct ``result``: n_words, places of the key phrases, labels and score.

    places holds (start, template, phrase) with words counted from 0, by start; labels are distinct and
    sorted. The score is 1 where a template is verified; key phrases of a notice that stand out of
    position give half of their share of its weight, and texts without any give 0. Null and empty texts
    have no words. Rows are judged one by one, so repeats and ties need no rule and empty tables stay
    empty; a column named like the result is replaced. A text is held whole, and its words once.
    """

    def judged(ws: Column) -> Column:
        def from_places(places: Column) -> Column:
            verdicts = F.array(*[_verdict(places, t, template, weights) for t, template in enumerate(templates)])
            return F.transform(
                F.array(verdicts),
                lambda vs: F.struct(
                    F.size(ws).cast("long").alias("n_words"),
                    places.alias("places"),
                    F.array_sort(F.array_distinct(F.filter(F.transform(vs, lambda v: v["label"]), lambda l: l.isNotNull()))).alias("labels"),
                    (F.array_max(F.transform(vs, lambda v: v["millionths"])) / 1e6).alias("score"),
                ),
            )[0]

        return F.transform(F.array(_places(ws, templates, weights)), from_places)[0]

    return docs.withColumn(result, F.transform(F.array(words_of(F.col(text))), judged)[0])
