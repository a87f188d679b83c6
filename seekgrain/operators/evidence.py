"""Evidence pool, selection of passages and the feature row of every candidate reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekgrain.functions import display, quality, text as tx
from seekgrain.functions import vocabulary as vocab
from seekgrain.operators.ranking import top_k
from seekgrain.presets import EvidenceSettings, Preset, TermSettings


def lineage_ok() -> Column:
    """Source file, positive page and citation are all present."""
    return (
        (tx.clean("source_file_name") != "")
        & (F.coalesce("page_number_1_based", F.lit(0)) > 0)
        & (tx.clean("citation_uri") != "")
    )


def showable() -> Column:
    return F.coalesce("approved_for_display", F.lit(True))


def measured_passages(passages: DataFrame) -> DataFrame:
    """Display text and quality measures of each passage, once, whatever the number of queries."""
    approved = F.when(tx.strip(F.coalesce("display_text", F.lit(""))) != "", F.col("display_text")).otherwise(
        F.col("chunk_text")
    )
    shown = passages.filter(showable() & lineage_ok()).withColumn("display_text", display.display_text(approved))
    return quality.measure(shown, "chunk_text", "display_text").drop("chunk_text")


def selection_score(terms: TermSettings) -> Column:
    """Weighted mix of quality, coverage, similarity, metadata overlap, exact bonus and signal."""
    dense = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("dense") + 1) / 2))
    bonus = F.least(F.col("exact_bonus") / terms.maximum_bonus, F.lit(1.0))
    return F.round(
        0.42 * F.col("quality_score")
        + 0.20 * F.col("coverage")
        + 0.15 * dense
        + 0.08 * F.least("metadata_support", F.lit(1.0))
        + 0.05 * bonus
        + 0.10 * F.col("project_delivery_signal").cast("double"),
        8,
    )


def content_tokens(text: Column | str) -> Column:
    return F.filter(tx.tokens(text), lambda t: ~t.isin(*vocab.STOPWORDS))


def evaluate_pool(
    pool: DataFrame, measured: DataFrame, passage: str, preset: Preset, profile: DataFrame, about: DataFrame
) -> DataFrame:
    """Gate and selection score of every pool row (query_id, reference_id, ``passage``, fused, dense).

    ``profile`` has query_id, query_tokens, query_concepts and query_language, ``about`` reference_id and
    reference_tokens. A passage meets the words of each query and of each reference once, and no pool row
    carries texts or word lists: there are as many as queries times references times passages of a pool.
    """
    terms = preset.terms
    words = measured.select(passage, "display_tokens")
    asked = pool.select("query_id", passage).distinct().join(words, passage)
    asked = asked.join(profile.select("query_id", "query_tokens", "query_concepts"), "query_id")
    exact = F.size(F.array_intersect(F.array_distinct("query_tokens"), F.col("display_tokens")))
    asked = quality.answers(asked).select(
        "query_id", passage, "coverage", "concept_evidence_support",
        F.least(exact * terms.bonus_per_term, F.lit(terms.maximum_bonus)).alias("exact_bonus"),
    )

    content = F.array_distinct(F.filter("display_tokens", lambda t: ~t.isin(*vocab.STOPWORDS)))
    n_reference = F.size(F.array_distinct("reference_tokens"))
    linked = pool.select("reference_id", passage).distinct().join(words, passage)
    linked = linked.join(about.select("reference_id", "reference_tokens"), "reference_id").select(
        "reference_id",
        passage,
        F.when(
            n_reference > 0,
            F.size(F.array_intersect("reference_tokens", content))
            / F.greatest(F.least(n_reference, F.lit(20)), F.lit(1)),
        )
        .otherwise(0.0)
        .alias("metadata_support"),
    )

    rows = pool.join(asked, ["query_id", passage]).join(linked, ["reference_id", passage])
    rows = rows.join(measured.drop("display_tokens", "display_text"), passage)
    rows = rows.join(profile.select("query_id", "query_tokens", "query_concepts", "query_language"), "query_id")
    rows = quality.judge(rows, preset.evidence).drop("query_tokens", "query_concepts")
    return rows.withColumn("selection_score", selection_score(terms))


def select_evidence(evaluated: DataFrame, passage: str, settings: EvidenceSettings) -> DataFrame:
    """Passing passages, best first by five keys, at most ``settings.passages`` per reference."""
    return top_k(
        evaluated.filter("quality_pass"),
        ["query_id", "reference_id"],
        [F.desc("selection_score"), F.desc("coverage"), F.desc("quality_score"), F.desc("dense"), F.col(passage)],
        settings.passages,
        "evidence_rank",
    )


def reference_groups(fused: DataFrame, links: DataFrame, passage: str, agreement_depth: int) -> DataFrame:
    """One row per (query, reference): best scores, passages, agreement and best-row equality."""
    rows = fused.join(links, passage)
    earlier = -F.col("fused_rank")
    both = (F.col("lexical_rank") <= agreement_depth) & (F.col("dense_rank") <= agreement_depth)
    return rows.groupBy("query_id", "reference_id").agg(
        F.max("fused").alias("best_fused"),
        F.max("lexical").alias("best_bm25"),
        F.max("dense").alias("best_dense"),
        F.count("*").alias("n_rows"),
        F.coalesce(F.bool_or(both), F.lit(False)).alias("_agreed"),
        (
            F.max_by(passage, F.struct("lexical", earlier)) == F.max_by(passage, F.struct("dense", earlier))
        ).alias("_same"),
    ).withColumn(
        "retriever_agreement", F.when(F.col("_agreed") & F.col("_same"), 2).when(F.col("_agreed"), 1).otherwise(0)
    ).drop("_agreed", "_same")


def mean_of_best(rows: DataFrame, keys: list[str], value: str, k: int, tie: str) -> DataFrame:
    """Mean of the ``k`` largest values of each group."""
    best = top_k(rows, keys, [F.desc(value), F.col(tie)], k, "_r")
    return best.groupBy(*keys).agg(F.avg(value).alias(f"mean_top_{value}"))


def evidence_pool(fused: DataFrame, links: DataFrame, passage: str, size: int) -> DataFrame:
    """First ``size`` passages of each reference in fused order."""
    return top_k(
        fused.join(links, passage), ["query_id", "reference_id"], [F.col("fused_rank")], size, "pool_rank"
    )


def evidence_features(selected: DataFrame) -> DataFrame:
    """Per (query, reference) facts about the selected passages."""
    return selected.groupBy("query_id", "reference_id").agg(
        F.max("coverage").alias("best_term_coverage"),
        F.count("*").alias("clean_evidence_passages"),
        F.max("quality_score").alias("best_evidence_quality"),
        F.max("dense").alias("best_selected_dense"),
        F.bool_or("semantic_cross_language_support").alias("cross_language_evidence"),
        F.bool_or("project_delivery_signal").alias("project_specific_evidence"),
    )
