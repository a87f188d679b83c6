"""Texts that stand in other texts, found through an anchor word instead of comparing every pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekgrain.session import hint_broadcast, is_bounded, reliable_checkpoint

#: A shorter text counts as a copy only when it equals the other one as a whole.
LEAST_CHARS = 80
#: Anchors, and the texts they belong to, up to which they are broadcast.
BOUNDED_ROWS = 20_000
#: Slices of a frequent anchor where both sides shuffle.
SLICES = 16


def inner_words(text: Column) -> Column:
    """Words between the first and the last space: a text that holds ``text`` has them as whole words."""
    listed = F.split(text, " ")
    return F.filter(F.slice(listed, F.lit(2), F.greatest(F.size(listed) - 2, F.lit(0))), lambda w: w != "")


def contained_texts(
    needles: DataFrame, needle_id: str, needle: str, texts: DataFrame, text_id: str, text: str, least_chars: int = LEAST_CHARS
) -> DataFrame:
    """(needle_id, text_id, relation): ``equal`` texts, and ``contains`` where a text holds a needle of ``least_chars`` or more.

    A needle that stands in a text has its inner words there as whole words, so the rarest of them over all
    texts is its anchor and only texts with that word are compared. A needle without an inner word has the
    length of its longest word as anchor: a text that holds it has a word as long. Equal texts meet by a
    fingerprint. Empty and null texts are copies of nothing; ids are expected once.
    """
    asked = needles.select(F.col(needle_id).alias("needle_id"), F.col(needle).alias("needle")).filter("needle <> ''")
    asked = reliable_checkpoint(asked)
    few = is_bounded(asked, BOUNDED_ROWS)
    held = texts.select(F.col(text_id).alias("text_id"), F.col(text).alias("text")).filter("text <> ''")

    prints = asked.select("needle_id", "needle", F.xxhash64("needle").alias("print"))
    equal = held.withColumn("print", F.xxhash64("text")).join(hint_broadcast(prints, few), "print")
    equal = equal.filter("text = needle").select("needle_id", "text_id", F.lit("equal").alias("relation"))

    long = asked.filter(F.length("needle") >= least_chars)
    words = long.select("needle_id", F.explode(F.array_distinct(inner_words(F.col("needle")))).alias("word"))
    in_texts = held.select("text_id", F.explode(F.array_distinct(F.split("text", " "))).alias("word"))
    wanted = words.select("word").distinct()
    counts = in_texts.join(hint_broadcast(wanted, few), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    rarest = Window.partitionBy("needle_id").orderBy("n", "word")
    # A word that no text has proves that the needle stands in none.
    ranked = words.join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    anchors = reliable_checkpoint(ranked.withColumn("place", F.row_number().over(rarest)).filter("place = 1 AND n > 0").select("needle_id", "word"))

    slices = SLICES if not few else 1
    slice_of = F.pmod(F.xxhash64("text_id"), F.lit(slices)).cast("int")
    dealt = anchors.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    met = in_texts.withColumn("slice", slice_of).join(hint_broadcast(dealt, few), ["word", "slice"]).select("needle_id", "text_id")

    def longest(value: Column) -> Column:
        return F.array_max(F.transform(F.split(value, " "), lambda w: F.length(w)))

    # Without an inner word: few texts have a word as long as one of these.
    whole = long.filter(F.size(inner_words(F.col("needle"))) == 0).select("needle_id", longest(F.col("needle")).alias("reach"))
    if not whole.isEmpty():
        least = whole.agg(F.min("reach")).first()[0]
        wide = held.select("text_id", longest(F.col("text")).alias("longest")).filter(F.col("longest") >= least)
        met = met.unionByName(wide.join(hint_broadcast(whole, few), F.col("longest") >= F.col("reach")).select("needle_id", "text_id"))
    met = reliable_checkpoint(met.distinct())
    pairs = met.join(hint_broadcast(asked, few), "needle_id").join(held, "text_id")
    inside = pairs.filter(F.contains("text", F.col("needle")) & (F.col("text") != F.col("needle")))
    return equal.unionByName(inside.select("needle_id", "text_id", F.lit("contains").alias("relation")))
