"""Batch build of the next corpus version."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekgrain import contracts
from seekgrain.functions import display, documents, quality
from seekgrain.operators import lifecycle
from seekgrain.presets import SELECTED, EvidenceSettings


@dataclass(frozen=True)
class CorpusVersion:
    chunks: DataFrame
    quarantine: DataFrame
    policy: DataFrame
    references: DataFrame


def rebuild_chunks(
    pages: DataFrame, settings: EvidenceSettings = SELECTED.evidence, maximum: int = 900, overlap: int = 120
) -> DataFrame:
    """Chunk, clean and gate repaired pages (document_id, page_number, original_text)."""
    chunks = documents.chunk_pages(pages, "original_text", maximum, overlap)
    shown = chunks.withColumn("display_text", display.clean_display("original_text"))
    blank = F.array().cast("array<string>")
    asked = quality.measure(shown, "original_text", "display_text").withColumns(
        {"query_language": F.lit("und"), "dense": F.lit(0.0), "query_tokens": blank, "query_concepts": blank}
    )
    gated = quality.gate(asked, settings).withColumn("approved_for_retrieval", F.col("quality_pass"))
    return gated.withColumn(
        "chunk_id",
        documents.stable_id(
            F.col("document_id"), F.col("page_number"), F.col("chunk_index"), F.sha2("original_text", 256)
        ),
    )


def build(
    chunks: DataFrame,
    repaired: DataFrame,
    review: DataFrame,
    audit: DataFrame,
    references: DataFrame,
    links: DataFrame,
) -> CorpusVersion:
    """Retained and rebuilt passages, quarantine, decisions and the catalog's new flags.

    ``repaired`` comes from :func:`rebuild_chunks`; ``links`` has (chunk_id, row_number).
    """
    replaced = repaired.groupBy("document_id", "page_number").agg(
        F.sort_array(F.collect_list(F.when(F.col("approved_for_retrieval"), F.col("chunk_id")))).alias("replacement_ids")
    )
    policy = lifecycle.resolve_policy(chunks, replaced, review, audit)
    contracts.require_true(
        policy, ~F.col("approved_for_display") | F.col("approved_for_retrieval"), "display approval without retrieval"
    )
    kept, out = lifecycle.split_quarantine(chunks, policy)
    accepted = repaired.filter("approved_for_retrieval")
    rejected = repaired.filter("not approved_for_retrieval").withColumn(
        "quarantine_reason", F.array_join("rejection_reasons", ";")
    )
    new_chunks = kept.unionByName(accepted, allowMissingColumns=True)
    contracts.require_unique(new_chunks, "chunk_id")
    surviving = links.join(new_chunks.select("chunk_id"), "chunk_id", "left_semi")
    return CorpusVersion(
        new_chunks,
        out.unionByName(rejected, allowMissingColumns=True),
        policy,
        lifecycle.recompute_eligibility(references, surviving),
    )
