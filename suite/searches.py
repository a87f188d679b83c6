"""Whole searches with both presets over the corpus laid on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekgrain.operators import catalog
from seekgrain.plans.search import search
from seekgrain.presets import BASELINE, SELECTED
from suite import corpus as model
from suite.base import Tables, query


@query("search_decisions_selected")
def _(t: Tables) -> DataFrame:
    trace = search(model.corpus(t), model.search_queries(t), SELECTED)
    return trace.decided.select(
        "query_id", "reference_id", "best_fused", "best_bm25", "best_dense", "best_term_coverage",
        "clean_evidence_passages", "reference_retriever_agreement", "relevance_reason", "relevant",
    )


@query("search_results_baseline")
def _(t: Tables) -> DataFrame:
    request = catalog.resolve_request({"period": {"preset": "last_10_years"}}, model.CURRENT_YEAR)
    trace = search(model.corpus(t), model.search_queries(t), BASELINE, request)
    return trace.results.select(
        "query_id", "relevance_rank", "reference_id", "reference_score", "best_dense", "best_passage",
        "supporting_passage", "best_term_coverage",
    )


@query("selected_evidence")
def _(t: Tables) -> DataFrame:
    trace = search(model.corpus(t), model.search_queries(t), SELECTED)
    return trace.selected.select(
        "query_id", "reference_id", "chunk_id", "evidence_rank", "selection_score", "coverage", "quality_score",
        F.length("display_text").alias("display_length"),
    )
