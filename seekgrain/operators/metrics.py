"""Information-retrieval metrics over ranked lists and graded judgments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekgrain.operators.ranking import row_numbers, top_k


def gain(grade: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1)


def per_query(
    ranked: DataFrame, judgments: DataFrame, query: str, item: str, k: int, digits: int = 6
) -> DataFrame:
    """success, precision, recall, reciprocal rank and nDCG at ``k`` for every judged query.

    ``ranked`` has (query, item, rank); ``judgments`` has (query, item, relevance). Precision
    divides by ``k`` even for shorter lists; a query without relevant items scores 0.
    """
    grades = judgments.groupBy(query, item).agg(F.max(F.col("relevance").cast("double")).alias("grade"))
    found = ranked.filter(F.col("rank") <= k).join(grades, [query, item], "left")
    relevant = F.coalesce(F.col("grade"), F.lit(0.0)) > 0
    lists = found.groupBy(query).agg(
        F.count_distinct(F.when(relevant, F.col(item))).alias("hits"),
        F.min(F.when(relevant, F.col("rank"))).alias("first_hit"),
        F.sum(gain(F.coalesce("grade", F.lit(0.0)), F.col("rank"))).alias("dcg"),
    )
    ideal = (
        top_k(grades, [query], [F.desc("grade"), F.col(item)], k, "ideal_rank")
        .groupBy(query)
        .agg(F.sum(gain(F.col("grade"), F.col("ideal_rank"))).alias("idcg"))
    )
    totals = grades.groupBy(query).agg(F.count_if(F.col("grade") > 0).alias("n_relevant"))
    hits = F.coalesce("hits", F.lit(0))
    return (
        totals.join(lists, query, "left")
        .join(ideal, query, "left")
        .select(
            query,
            F.when(hits > 0, 1.0).otherwise(0.0).alias(f"success_at_{k}"),
            F.round(hits / F.lit(k), digits).alias(f"precision_at_{k}"),
            F.round(F.when(F.col("n_relevant") > 0, hits / F.col("n_relevant")).otherwise(0.0), digits).alias(
                f"recall_at_{k}"
            ),
            F.round(F.coalesce(1 / F.col("first_hit"), F.lit(0.0)), digits).alias(f"mrr_at_{k}"),
            F.round(
                F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).otherwise(0.0), digits
            ).alias(f"ndcg_at_{k}"),
        )
    )


def macro(metrics: DataFrame, query: str) -> DataFrame:
    return metrics.agg(*[F.round(F.avg(c), 6).alias(c) for c in metrics.columns if c != query])


def truthy(value: Column) -> Column:
    return F.lower(F.trim(value)).isin("1", "true", "yes", "y")


def run_summary(runs: DataFrame) -> DataFrame:
    """No-answer false positives, empty answers, languages and latency of a set of runs.

    ``runs`` has query_language, cross_language_expected, no_answer_expected, result_count and
    latency_ms.
    """
    latency = quantiles_by(runs, [], "latency_ms", p50=0.5, p95=0.95)
    no_answer, some = truthy(F.col("no_answer_expected")), F.col("result_count") > 0
    return runs.agg(
        F.count("*").alias("evaluated_queries"),
        F.count_if(no_answer).alias("no_answer_queries"),
        F.count_if(~no_answer).alias("answerable_queries"),
        F.round(
            F.count_if(no_answer & some) / F.nullif(F.count_if(no_answer), F.lit(0)), 6
        ).alias("no_answer_false_positive_rate"),
        F.round(
            F.count_if(~no_answer & ~some) / F.nullif(F.count_if(~no_answer), F.lit(0)), 6
        ).alias("answerable_zero_result_rate"),
        F.count_if(truthy(F.col("cross_language_expected"))).alias("cross_language_sample_count"),
        F.round(F.lit(latency.select("p50").scalar()), 2).alias("p50_latency_ms"),
        F.round(F.lit(latency.select("p95").scalar()), 2).alias("p95_latency_ms"),
    )


def quantiles_by(df: DataFrame, keys: list[str], value: str, **points: float) -> DataFrame:
    """Exact interpolated quantiles of groups of any size.

    Values are ranked over range partitions; only the two ranks around each quantile are kept, so
    no task ever holds the values of a whole group.
    """
    rows = df.select(*keys, value).filter(F.col(value).isNotNull())
    # With a tie-breaker one value that many rows share can be split over slices.
    rows = rows.withColumn("_tie", F.monotonically_increasing_id())
    ranked = row_numbers(rows, [value, F.xxhash64("_tie")], "_r", keys)
    if not keys:
        ranked = ranked.withColumn("_all", F.lit(1))
    groups = keys or ["_all"]
    sizes = ranked.groupBy(*groups).agg(F.max("_r").alias("_n"))
    near = F.lit(False)
    for p in points.values():
        place = (F.col("_n") - 1) * F.lit(float(p)) + 1
        near = near | F.col("_r").isin(F.floor(place), F.ceil(place))
    kept = ranked.join(sizes, groups).filter(near)

    def quantile(p: float) -> Column:
        place = (F.col("_n") - 1) * F.lit(float(p)) + 1
        low = F.max(F.when(F.col("_r") == F.floor(place), F.col(value)))
        high = F.max(F.when(F.col("_r") == F.ceil(place), F.col(value)))
        part = F.max(place - F.floor(place))
        return low + (high - low) * part

    return kept.groupBy(*groups).agg(*[quantile(p).alias(n) for n, p in points.items()]).select(*keys, *points)
