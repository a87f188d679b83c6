"""Mixing sources to target weights with Sainte-Laguë apportionment.

The mix is made of blocks of equal token counts. Sources get whole numbers of blocks by highest
quotients target / (2k + 1). A source asked for more than it has gives all its documents once and
the rest again. What remains is split among the source's shards by the same rule, and every shard
gives a run of its blocks that begins at a seeded place of a seeded permutation of its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekgrain.llm.common import WORD, counted_broadcast, unused, written
from seekgrain.operators.ranking import row_numbers

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MOST_TIMES = 2
#: Tokens of a block at most; a small corpus has smaller blocks, so that it still has MANY_BLOCKS.
BLOCK_TOKENS = 1024
MANY_BLOCKS = 100_000
#: A shard holds about so many tokens, and so many rows, at most.
SHARD_TOKENS, SHARD_ROWS = 1 << 22, 20_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, percent: int = SHARE_PERCENT, times: int = MOST_TIMES) -> DataFrame:
    """``sources(source, source_size)`` with ``target``: shares by weight, none above ``times`` its size.

    Sources by code point, null last, take the weights in turn. Ordered by cap per weight, the capped
    ones come first; after k of them every further source gets the level (whole - caps) / weights left. The
    level rises until its next source can bear it and falls from there, so it is the highest one borne.
    One row per source, so one task orders them.
    """
    listed = F.array(*[F.lit(w) for w in weights])
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sources.withColumn("weight", F.get(listed, (F.row_number().over(order) - 1) % len(weights)))
    rows = rows.withColumn("cap", times * F.col("source_size"))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, on = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    rows = rows.withColumn(
        "level",
        (F.sum("source_size").over(everything) * percent / 100 - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        / F.sum("weight").over(on),
    )
    borne = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    rows = rows.withColumn("water", F.max(borne).over(everything))
    target = F.least(F.col("cap").cast("double"), F.col("water") * F.col("weight"))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def apportion(parties: DataFrame, group: list[str], vote: str, seats: str, name: str) -> DataFrame:
    """Whole seats of ``seats`` for the parties of each group, by highest quotients vote / (2k + 1).

    Rounding vote * seats / votes to the nearest number is off by a few seats; the candidates around
    it are ranked by quotient and the first ``seats`` taken. Ties go to the smaller party key.
    """
    keys = [c for c in parties.columns if c not in (vote, seats, *group)]
    every = Window.partitionBy(*group)
    fair = F.floor(F.try_divide(F.col(vote) * F.col(seats), F.sum(vote).over(every)) + F.lit(0.5))
    around = parties.withColumn("_fair", F.coalesce(fair, F.lit(0)).cast("long"))
    around = around.withColumn("_sure", F.greatest(F.col("_fair") - 3, F.lit(0)).cast("long"))
    around = around.withColumn("_left", (F.col(seats) - F.sum("_sure").over(every)).cast("long"))
    candidates = around.withColumn("_k", F.explode(F.sequence(F.col("_sure"), F.col("_fair") + 3)))
    quotient = F.col(vote) / (2 * F.col("_k") + 1)
    rank = Window.partitionBy(*group).orderBy(quotient.desc(), *[F.col(k).asc_nulls_last() for k in keys], "_k")
    won = candidates.withColumn("_rank", F.row_number().over(rank)).withColumn(
        "_won", ((F.col("_rank") <= F.col("_left")) & (F.col(vote) > 0)).cast("long")
    )
    return won.groupBy(*parties.columns).agg((F.first("_sure") + F.sum("_won")).cast("long").alias(name))


def seeded(seed: int, *parts: str) -> Column:
    """A hash that other SQL engines can repeat."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(p).cast("string"), F.lit("-")) for p in parts]))


def hash_number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0) -> DataFrame:
    """doc_id, source, size, source_size, target, first_word, taken_once, taken: what the mix takes of every row.

    ``taken`` words, repeats counted: ``size`` for each whole pass over the source plus ``taken_once``
    words of the last, partial one, from ``first_word`` on (it wraps round at the end of the text).
    Null text has size 0, null is a source of its own, and rows equal in id and text are taken in any
    order; ``text_hash`` (MD5) tells the texts of one id apart. An empty table gives no rows; other columns
    are not looked at.
    """
    sizes = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), F.md5(text).alias("text_hash")
    )
    sizes = written(sizes.withColumn("place", seeded(seed, "doc_id", "size", "text_hash")))
    sources = written(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows")))
    goals = targets(sources.drop("n_rows"))
    every = Window.partitionBy()
    total = F.sum("source_size").over(every)
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK_TOKENS), F.floor(total / MANY_BLOCKS))).cast("long")
    goals = goals.withColumn("block", block).withColumn(
        "blocks", F.floor(F.sum("target").over(every) / F.col("block") + F.lit(0.5)).cast("long")
    )
    won = apportion(goals.select("source", "target", "blocks"), [], "target", "blocks", "quota")
    goals = goals.join(won.select(F.col("source").alias("s"), "quota"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    words_due = F.col("quota") * F.col("block")
    passes = F.when(F.col("source_size") > 0, F.least(F.lit(MOST_TIMES), F.floor(words_due / F.col("source_size"))))
    goals = goals.withColumn("passes", F.coalesce(passes, F.lit(0)).cast("long"))
    rest = F.when(F.col("passes") < MOST_TIMES, words_due - F.col("passes") * F.col("source_size")).otherwise(0)
    goals = goals.withColumn("rest_blocks", F.floor(rest / F.col("block") + F.lit(0.5)).cast("long"))
    n_rows = sources.select(F.col("source").alias("s"), "n_rows")
    goals = goals.join(n_rows, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    shards = F.ceil(F.greatest(F.col("source_size") / SHARD_TOKENS, F.col("n_rows") / SHARD_ROWS, F.lit(1)))
    goals = goals.withColumn("shards", shards.cast("long"))
    goals = written(
        goals.select(F.col("source").alias("s"), "source_size", "target", "block", "passes", "rest_blocks", "shards")
    )
    with_source = sizes.join(counted_broadcast(goals), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = with_source.withColumn("shard", F.pmod(hash_number(F.col("place")), F.col("shards")))
    shards = rows.groupBy("source", "shard", "block", "rest_blocks").agg(F.sum("size").alias("shard_size"))
    walk = Window.partitionBy("source", "shard").orderBy("place", "doc_id", "size")
    rows = rows.withColumn("end", F.sum("size").over(walk.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("start", F.col("end") - F.col("size"))
    quotas = apportion(
        shards.select("source", "rest_blocks", "shard", "shard_size"), ["source", "rest_blocks"], "shard_size",
        "rest_blocks", "shard_blocks",
    )
    n_blocks = F.greatest(F.ceil(F.col("shard_size") / F.col("block")), F.lit(1)).cast("long")
    begin = F.pmod(hash_number(seeded(seed, "source", "shard")), F.col("n_blocks"))
    quotas = quotas.select(
        F.col("source").alias("s"), F.col("shard").alias("h"), "shard_size", "shard_blocks",
    )
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("h"))
    rows = rows.join(quotas, same).drop("s", "h").withColumn("n_blocks", n_blocks)
    rows = rows.withColumn("from", begin * F.col("block"))
    rows = rows.withColumn("to", F.least(F.col("from") + F.col("shard_blocks") * F.col("block"), F.col("from") + F.col("shard_size")))

    def overlap(low: Column, high: Column) -> Column:
        return F.greatest(F.lit(0), F.least("end", high) - F.greatest("start", low)).cast("long")

    straight = overlap(F.col("from"), F.col("to"))
    wrapped = overlap(F.lit(0), F.col("to") - F.col("shard_size"))
    first = F.when(straight > 0, F.greatest(F.lit(0), F.col("from") - F.col("start"))).otherwise(0)
    rows = rows.withColumn("taken_once", F.least("size", straight + wrapped)).withColumn("first_word", first.cast("long"))
    taken = F.col("passes") * F.col("size") + F.col("taken_once")
    return rows.select(
        "doc_id", "source", "size", "text_hash", "source_size", "target", "passes", "first_word", "taken_once", taken.alias("taken")
    )


def mixed_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0) -> DataFrame:
    """The mix itself: every row of ``docs`` none, one or two times, with the columns of ``docs``.

    Documents stay whole: one that the last, partial pass takes in part comes in when at least half of it
    is taken. Rows equal in id, source and text share one decision, unless the partial pass begins or ends
    among them; then they are numbered, by a hash of all their columns, and the first ones come in. Reruns
    agree; null ids, texts and sources are values like others, and an empty table stays empty.
    """
    key, times, share, place, row, number = (unused(docs, n) for n in ("_key", "_times", "_share", "_place", "_row", "_number"))
    copies = F.col("passes") + ((F.col("taken_once") > 0) & (2 * F.col("taken_once") >= F.col("size"))).cast("long")
    decided = mix(docs, doc_id, text, source, seed).select(F.xxhash64("doc_id", "source", "text_hash").alias(key), copies.alias("copies"))
    counts = [F.count_if(F.col("copies") >= t).alias(f"n{t}") for t in range(1, MOST_TIMES + 1)]
    decided = decided.groupBy(key).agg(F.min("copies").alias("least"), F.max("copies").alias("most"), *counts)
    decided = written(decided.filter("most > 0"))
    rows = docs.withColumn(key, F.xxhash64(doc_id, source, F.md5(text)))
    even = decided.filter("least = most").select(key, F.col("most").cast("int").alias(times))
    taken = rows.join(even, key)
    uneven = decided.filter("least < most").select(key, F.struct(*[c for c in decided.columns if c[0] == "n"]).alias(share))
    uneven = counted_broadcast(uneven)
    if not uneven.isEmpty():
        some = written(rows.join(uneven, key).withColumns({place: F.xxhash64(*docs.columns), row: F.monotonically_increasing_id()}))
        some = row_numbers(some, [place, row], number, [key])
        part = F.lit(0)
        for t in range(1, MOST_TIMES + 1):
            part = part + (F.col(number) <= F.col(share)[f"n{t}"]).cast("int")
        taken = taken.unionByName(some.withColumn(times, part).filter(F.col(times) > 0).select(*docs.columns, key, times))
    again = unused(docs, "_again")
    return taken.withColumn(again, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)
