"""Ranks, top-k and rank fusion that never place one whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekgrain.session import reliable_checkpoint

SALT_FROM = 200


def _names(order: Sequence[Column | str]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def top_k(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    k: int,
    rank: str = "rank",
    salt_on: str | None = None,
    salts: int = 64,
) -> DataFrame:
    """First ``k`` rows of each group with their rank.

    Spark prunes to ``k`` rows per group in every input task before the shuffle. For a deep
    list (``salt_on`` given) a first round over ``salts`` slices of the group keeps the last task at
    ``salts * k`` rows, whatever the number of input tasks. A slice is made of whole input tasks, so
    that they still prune to ``k`` rows per group; a hash of the key would leave each of them all rows.
    """
    order = _names(order)
    if salt_on is not None and k >= SALT_FROM:
        salted = df.withColumn("_slice", F.pmod(F.spark_partition_id(), F.lit(salts)))
        inner = Window.partitionBy(*keys, "_slice").orderBy(*order)
        df = salted.withColumn(rank, F.row_number().over(inner)).filter(F.col(rank) <= k).drop("_slice", rank)
    final = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(final)).filter(F.col(rank) <= k)


def row_numbers(
    df: DataFrame, order: Sequence[Column | str], name: str = "rank", keys: Sequence[str] = ()
) -> DataFrame:
    """Exact 1-based positions over the whole table, or over groups of any size.

    Rows are range partitioned by (keys, order) and written to a checkpoint, so that counting a
    slice and numbering its rows see the same rows. Only groups that cross a slice border need an
    offset; there are fewer of those than slices, so the offsets are broadcast.
    """
    spark = df.sparkSession
    order = _names(order)
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(slices, *[F.col(k).asc() for k in keys], *order)
    ranged = reliable_checkpoint(ranged.withColumn("_slice", F.spark_partition_id()))
    counts = ranged.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    if keys:
        split = counts.groupBy(*keys).agg(F.collect_list(F.struct("_slice", "_n")).alias("_parts"))
        split = split.filter(F.size("_parts") > 1)
    else:
        split = counts.agg(F.collect_list(F.struct("_slice", "_n")).alias("_parts"))
    offsets = split.select(*keys, F.explode("_parts").alias("_p"), "_parts").select(
        *keys,
        F.col("_p._slice").alias("_slice"),
        F.expr(
            "aggregate(filter(_parts, x -> x._slice < _p._slice), 0L, (a, x) -> a + x._n)"
        ).alias("_offset"),
    )
    local = Window.partitionBy("_slice", *keys).orderBy(*order)
    return (
        ranged.withColumn("_local", F.row_number().over(local))
        .join(F.broadcast(offsets), [*keys, "_slice"], "left")
        .withColumn(name, (F.col("_local") + F.coalesce("_offset", F.lit(0))).cast("long"))
        .drop("_slice", "_local", "_offset")
    )


def page_of(ranked: DataFrame, page: int, size: int, rank: str = "rank") -> DataFrame:
    """One page of an already ranked table."""
    return ranked.filter(F.col(rank).between((page - 1) * size + 1, page * size))


def page_count(total: Column, size: int) -> Column:
    return F.ceil(total / F.lit(size)).cast("long")


def zero_filled(
    hits: DataFrame, queries: DataFrame, passages: DataFrame, depth: int, query: str, key: str
) -> DataFrame:
    """Add score-0 passages so that a lane can rank every eligible passage.

    A lane keeps ``depth`` rows and breaks ties by key, so only the ``depth`` smallest keys can
    enter it with score 0; they come as one bounded array per query. Hits beyond the first ``depth`` of a
    query cannot enter it either and are dropped before they meet the zeros.
    """
    hits = top_k(hits, [query], [F.desc("score"), F.col(key)], depth, "_best", salt_on=key)
    first = passages.select(key).orderBy(key).limit(depth).agg(F.sort_array(F.collect_list(key)).alias("_first"))
    fill = queries.select(query).distinct().select(
        query, F.explode(first.scalar()).alias(key), F.lit(0.0).alias("score")
    )
    return (
        hits.select(query, key, "score")
        .unionByName(fill)
        .groupBy(query, key)
        .agg(F.max("score").alias("score"))
    )


def fuse(
    lexical: DataFrame,
    dense: DataFrame,
    query: str,
    key: str,
    lexical_weight: float,
    dense_weight: float,
    rrf_k: int = 60,
) -> DataFrame:
    """Weighted reciprocal-rank fusion of two ranked lanes (columns: query, key, rank, score)."""
    lanes = lexical.select(
        query,
        key,
        (F.lit(lexical_weight) / (rrf_k + F.col("rank"))).alias("part"),
        F.col("score").alias("lexical_score"),
        F.lit(None).cast("double").alias("dense_score"),
        F.col("rank").alias("lexical_rank"),
        F.lit(None).cast("int").alias("dense_rank"),
    ).unionByName(
        dense.select(
            query,
            key,
            (F.lit(dense_weight) / (rrf_k + F.col("rank"))).alias("part"),
            F.lit(None).cast("double").alias("lexical_score"),
            F.col("score").alias("dense_score"),
            F.lit(None).cast("int").alias("lexical_rank"),
            F.col("rank").alias("dense_rank"),
        )
    )
    return lanes.groupBy(query, key).agg(
        F.round(F.sum("part"), 10).alias("fused"),
        F.max("lexical_score").alias("lexical_score"),
        F.max("dense_score").alias("dense_score"),
        F.max("lexical_rank").alias("lexical_rank"),
        F.max("dense_rank").alias("dense_rank"),
    )


def lane_overlap(fused: DataFrame, query: str, depth: int = 10) -> DataFrame:
    """Passages that both lanes rank within ``depth``, per query."""
    return fused.groupBy(query).agg(
        F.count_if((F.col("lexical_rank") <= depth) & (F.col("dense_rank") <= depth)).alias("top_agreement")
    )


def first_of_entity(ranked: DataFrame, query: str, entity: str, key: str, rank: str = "rank") -> DataFrame:
    """Rank entities by the first passage that mentions them."""
    best = ranked.groupBy(query, entity).agg(
        F.min(F.struct(F.col(rank).alias("r"), F.col(key).alias("k"), F.col("score").alias("s"))).alias("b")
    )
    best = best.select(
        query,
        entity,
        F.col("b.r").alias("first_rank"),
        F.col("b.k").alias("best_key"),
        F.col("b.s").alias("best_score"),
    )
    return row_numbers(best, ["first_rank", entity], "entity_rank", [query])
