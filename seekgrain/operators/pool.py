"""Candidate pool for blind judging: priority over lanes, cap and deterministic shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekgrain.operators.ranking import top_k

POOL_SIZE = 25


def priority(lane_ranks: DataFrame, query: str, item: str, lanes: list[str], size: int = POOL_SIZE) -> DataFrame:
    """Order candidates of each query: the first of every lane in lane order, then by best rank,
    number of lanes, hybrid rank and id. ``lane_ranks`` has (query, item, lane, rank)."""
    order = F.array_position(F.array(*[F.lit(lane) for lane in lanes]), F.col("lane"))
    lead = top_k(lane_ranks, [query, "lane"], [F.col("rank"), F.col(item)], 1, "_first")
    leads = lead.groupBy(query, item).agg(F.min(order).alias("_lead"))
    merged = lane_ranks.groupBy(query, item).agg(
        F.min("rank").alias("best_rank"),
        F.count_distinct("lane").alias("n_lanes"),
        F.min(F.when(F.col("lane").endswith("hybrid"), F.col("rank"))).alias("hybrid_rank"),
    )
    joined = merged.join(leads, [query, item], "left").withColumn("_lead", F.coalesce("_lead", F.lit(len(lanes) + 1)))
    ranked = top_k(
        joined,
        [query],
        [
            F.col("_lead"),
            F.when(F.col("_lead") <= len(lanes), 0).otherwise(F.col("best_rank")),
            F.desc("n_lanes"),
            F.col("hybrid_rank").asc_nulls_last(),
            F.col(item),
        ],
        size,
        "pool_position",
    )
    return ranked.drop("_lead")


def blind_order(pool: DataFrame, query: str, item: str, seed: str, size: int = POOL_SIZE) -> DataFrame:
    """Shuffle each query's pool by a seeded hash and number it C01, C02, ..."""
    keyed = pool.withColumn("order_key", F.sha2(F.concat_ws("|", F.lit(seed), F.col(query), F.col(item)), 256))
    ranked = top_k(keyed, [query], [F.col("order_key")], size, "blind_position")
    return ranked.withColumn(
        "blinded_candidate_id", F.format_string("%s-C%02d", F.col(query).cast("string"), F.col("blind_position"))
    )


def pool_checks(pool: DataFrame, query: str, item: str, size: int = POOL_SIZE) -> DataFrame:
    """Rows, distinct candidates and breaches of the cap, in one row."""
    per_query = pool.groupBy(query).agg(F.count("*").alias("n"), F.count_distinct(item).alias("d"))
    return per_query.agg(
        F.count("*").alias("n_queries"),
        F.sum("n").alias("n_rows"),
        F.max("n").alias("largest"),
        F.count_if(F.col("n") != F.col("d")).alias("n_with_repeats"),
        F.count_if(F.col("n") > size).alias("n_over_size"),
    )
