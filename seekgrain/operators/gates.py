"""Reference aggregation, relevance and abstention decisions, match reasons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekgrain.functions import text as tx
from seekgrain.operators.ranking import top_k
from seekgrain.presets import AbstentionSettings, RelevanceSettings

STRATEGIES = ("A_MAX", "B_TOP2_MEAN", "C_BEST_PLUS_SUPPORT", "D_FIELD_AGREEMENT")
COHERENT_DENSE = 0.72


def best_two(evidence: DataFrame, keys: Sequence[str], passage: str) -> DataFrame:
    """The two strongest passages of every group, side by side. Every input task passes on at most
    two rows per group, so a group with a third of all rows costs no more than a small one."""
    order = [F.desc("fused"), F.desc("selection_score"), F.col(passage)]
    two = top_k(evidence, list(keys), order, 2, "_n")

    def nth(n: int, column: str) -> Column:
        return F.max(F.when(F.col("_n") == n, F.col(column)))

    return two.groupBy(*keys).agg(
        nth(1, passage).alias("best_passage"),
        nth(2, passage).alias("supporting_passage"),
        nth(1, "fused").alias("best"),
        nth(2, "fused").alias("second"),
        nth(2, "coverage").alias("second_coverage"),
        nth(2, "dense").alias("second_dense"),
    )


def strategy_score(strategy: str, bonus: float = 0.0008, agreement: Column | None = None) -> Column:
    """Score of a reference from its ``best`` and ``second`` passage."""
    best = F.coalesce("best", F.lit(0.0))
    if strategy == "A_MAX":
        return best
    if strategy == "B_TOP2_MEAN":
        return F.when(F.col("second").isNotNull(), (best + F.col("second")) / 2).otherwise(best)
    if strategy == "C_BEST_PLUS_SUPPORT":
        return best + F.when(coherent_second(), F.lit(bonus)).otherwise(0.0)
    if strategy == "D_FIELD_AGREEMENT":
        fields = F.lit(0) if agreement is None else agreement
        return best + bonus * F.least(fields, F.lit(3))
    raise ValueError(f"Unknown reference aggregation strategy: {strategy}")


def coherent_second() -> Column:
    return F.col("second").isNotNull() & (
        (F.coalesce("second_coverage", F.lit(0.0)) > 0)
        | (F.coalesce("second_dense", F.lit(-1.0)) >= COHERENT_DENSE)
    )


def scope_terms_hit(query_tokens: Column, scope_terms: Sequence[str]) -> Column:
    """A term outside the portfolio occurs as whole tokens. A term without any usable token is
    skipped instead of matching every query."""
    test = F.lit(False)
    for term in scope_terms:
        phrase = F.array_join(tx.tokens(F.lit(term)), " ")
        test = test | ((phrase != "") & tx.has_phrase(query_tokens, phrase))
    return test


def query_problem(text: Column, maximum: int = 1000) -> Column:
    """Reason code of an unusable query, else null."""
    stripped = tx.strip(text)
    return (
        F.when(text.isNull(), "MALFORMED_QUERY")
        .when(stripped == "", "EMPTY_QUERY")
        .when(F.length(stripped) > maximum, "QUERY_TOO_LONG")
        .when(F.regexp_like(stripped, F.lit(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")), "MALFORMED_QUERY")
    )


def abstention_reason(s: AbstentionSettings, out_of_scope: Column | None = None) -> Column:
    """First rule that applies, on a table of candidate features."""
    c = F.col
    exact = (c("best_bm25") >= s.exact_override) & (c("best_term_coverage") > 0)
    semantic = (c("best_dense") >= s.strong_dense) & (c("mean_top_dense") >= s.minimum_mean_dense)
    crossing = c("cross_language_evidence") & (c("best_selected_dense") >= s.semantic_only_dense)
    lexical_ok = (c("best_bm25") >= s.minimum_bm25) & (c("best_term_coverage") >= s.minimum_coverage)
    semantic_ok = (c("best_dense") >= s.semantic_only_dense) & (c("best_evidence_quality") >= s.minimum_quality)
    override = exact | semantic | crossing
    return (
        F.when(F.lit(False) if out_of_scope is None else out_of_scope, "UNSUPPORTED_PORTFOLIO_SCOPE")
        .when((c("eligible_chunks") == 0) | (c("candidate_references") == 0), "NO_ELIGIBLE_REFERENCE")
        .when(c("meaningful_query_token_count") < s.minimum_tokens, "NO_MEANINGFUL_QUERY_TERMS")
        .when(c("clean_evidence_passages") == 0, "NO_USABLE_EVIDENCE")
        .when((F.size("query_concepts") > 0) & ~c("metadata_compatibility"), "METADATA_MISMATCH")
        .when(
            ~(lexical_ok | semantic_ok | override),
            F.when(c("best_dense") >= s.minimum_dense, "INSUFFICIENT_LEXICAL_EVIDENCE").otherwise(
                "INSUFFICIENT_SEMANTIC_EVIDENCE"
            ),
        )
        .when(~override & (c("retriever_agreement") < s.minimum_agreement), "LOW_RETRIEVER_AGREEMENT")
        .when(c("independent_passages") < s.minimum_passages, "NO_ELIGIBLE_REFERENCE")
        .otherwise("SUFFICIENT_EVIDENCE")
    )


def relevance_patterns(s: RelevanceSettings) -> Column:
    c = F.col
    specific = c("project_specific_evidence")
    strong_lexical = (
        (c("strong_exact_term_count") >= 1)
        & (c("best_bm25") >= s.field_lexical)
        & (c("best_term_coverage") >= s.evidence_coverage)
    )
    strong_semantic = (
        (c("best_dense") >= s.strong_dense)
        & c("metadata_compatibility")
        & ((c("capability_field_support") >= 1) | (c("clean_evidence_passages") >= 2))
    )
    agreeing = (c("reference_retriever_agreement") >= 1) & (c("best_term_coverage") >= s.agreement_coverage)
    technical = (
        (c("technology_acronym_match_count") >= 1)
        & c("evidence_field_support")
        & ((c("best_term_coverage") > 0) | (c("best_dense") >= s.technology_dense_floor))
    )
    return F.array_compact(
        F.array(
            F.when(strong_lexical & specific, "PATTERN_A_STRONG_LEXICAL"),
            F.when(strong_semantic & specific, "PATTERN_B_STRONG_SEMANTIC"),
            F.when(agreeing & specific, "PATTERN_C_RETRIEVER_AGREEMENT"),
            F.when(technical & specific, "PATTERN_D_EXACT_CAPABILITY_TECHNOLOGY"),
        )
    )


def relevance_reason(s: RelevanceSettings, patterns: Column, out_of_scope: Column | None = None) -> Column:
    c = F.col
    return (
        F.when(F.lit(False) if out_of_scope is None else out_of_scope, "UNSUPPORTED_PORTFOLIO_SCOPE")
        .when(c("meaningful_query_token_count") == 0, "NO_MEANINGFUL_QUERY_TERMS")
        .when(c("clean_evidence_passages") == 0, "NO_USABLE_EVIDENCE")
        .when(~c("valid_lineage"), "INVALID_SOURCE_LINEAGE")
        .when((F.size("query_concepts") > 0) & ~c("metadata_compatibility"), "CAPABILITY_CONTRADICTION")
        .when(F.size(patterns) > 0, "SUFFICIENT_RELEVANCE_AND_EVIDENCE")
        .when(
            (c("best_bm25") < s.field_lexical) & (c("best_dense") < s.dense_floor),
            "WEAK_LEXICAL_AND_SEMANTIC_SUPPORT",
        )
        .when(~c("project_specific_evidence"), "GENERIC_OR_BOILERPLATE_EVIDENCE")
        .when((c("capability_field_support") == 0) & ~c("evidence_field_support"), "METADATA_ONLY_MATCH")
        .when(
            (c("clean_evidence_passages") == 1)
            & (c("strong_exact_term_count") == 0)
            & (c("reference_retriever_agreement") == 0),
            "SINGLE_ACCIDENTAL_SEMANTIC_NEIGHBOR",
        )
        .otherwise("INSUFFICIENT_RELEVANCE_EVIDENCE")
    )


def decide(features: DataFrame, s: RelevanceSettings, out_of_scope: Column | None = None) -> DataFrame:
    """Add ``passing_patterns``, ``relevance_reason`` and ``relevant``."""
    hit = features.withColumn("passing_patterns", relevance_patterns(s))
    hit = hit.withColumn("relevance_reason", relevance_reason(s, F.col("passing_patterns"), out_of_scope))
    return hit.withColumn("relevant", F.col("relevance_reason") == "SUFFICIENT_RELEVANCE_AND_EVIDENCE")


def outcome(decided: DataFrame, query: str) -> DataFrame:
    """Per query: answered, or why nothing was retained."""
    return decided.groupBy(query).agg(
        F.count("*").alias("n_candidates"),
        F.count_if("relevant").alias("n_relevant"),
        F.bool_and(F.col("relevance_reason") == "UNSUPPORTED_PORTFOLIO_SCOPE").alias("_scope"),
    ).select(
        query,
        "n_candidates",
        "n_relevant",
        F.when(F.col("n_relevant") > 0, "SUFFICIENT_EVIDENCE")
        .when(F.col("_scope"), "UNSUPPORTED_PORTFOLIO_SCOPE")
        .otherwise("NO_RELEVANT_REFERENCE")
        .alias("outcome"),
    )


def sort_order(mode: str) -> list[Column]:
    """Order of a result page; relevance rank settles ties."""
    rank = F.col("relevance_rank")
    if mode == "relevance":
        return [rank]
    if mode == "newest":
        return [F.desc(F.coalesce("end_year", "start_year", F.lit(-1))), rank]
    if mode == "oldest":
        return [F.coalesce("start_year", F.lit(9999)).asc(), rank]
    if mode in ("project_title", "client", "country"):
        return [tx.fold(mode).asc(), rank]
    raise ValueError(f"unknown sort mode: {mode}")
