"""Audit of the links between passages and references: wrong documents, contradicting concepts.

What a passage is linked to is folded into one row by mergeable aggregates (OR of concept bits, "any
document", "own document"), so a reference may be linked by any share of the passages.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekgrain.functions import text as tx
from seekgrain.functions import vocabulary as vocab
from seekgrain.operators import corpus_audit, lexical
from seekgrain.session import BROADCAST_ROWS, hint_broadcast, is_bounded

# Reasons of a doubtful link, and catalog columns whose words tell a reference's concepts.
MISMATCH, CONFLICT, UNLINKED = "DOCUMENT_LINK_MISMATCH", "DISJOINT_CAPABILITY_CONCEPTS", "NO_LINKED_ELIGIBLE_REFERENCE"
DESCRIBING = ("service_nature", "offering")

MILLION = 1_000_000
Concepts = Mapping[str, Sequence[str]]


def _bits(names: Column, concepts: Concepts) -> Column:
    """A set of at most 63 concept names as one integer, so that sets are united by OR."""
    total = F.lit(0).cast("long")
    for place, name in enumerate(concepts):
        total = total + F.when(F.array_contains(names, name), F.lit(1 << place).cast("long")).otherwise(0)
    return total


def _names(bits: Column, concepts: Concepts) -> Column:
    """The concept names of such an integer, sorted."""
    held = [F.when(bits.bitwiseAND(1 << place) > 0, F.lit(name)) for place, name in enumerate(concepts)]
    return F.array_sort(F.array_compact(F.array(*held)))


def link_facts(
    passages: DataFrame,
    references: DataFrame,
    key: str,
    document: str,
    concepts: Concepts = vocab.QUERY_CONCEPTS,
    describing: Sequence[str] = DESCRIBING,
) -> DataFrame:
    """One row per passage with at least one known reference.

    ``passages`` has ``key`` (unique), ``document`` and ``reference_rows_json``; ``references`` has
    ``row_number`` (unique), ``reference_id``, ``canonical_document_id`` and the ``describing`` columns.
    Entries of the JSON list that are no integers or name no reference are skipped, as is a list that
    does not parse; a number listed twice counts once. A phrase counts when one reference holds it.
    """
    described = references.select(
        "row_number",
        "reference_id",
        F.coalesce(F.col("canonical_document_id").cast("string"), F.lit("")).alias("_document"),
        _bits(lexical.concepts(tx.tokens(F.concat_ws(" ", *describing)), concepts), concepts).alias("_bits"),
    )
    listed = F.transform(F.from_json("reference_rows_json", "array<string>"), lambda v: v.try_cast("int"))
    links = passages.select(
        key,
        F.coalesce(F.col(document).cast("string"), F.lit("")).alias("_own"),
        F.explode(F.array_distinct(listed)).alias("row_number"),
    )
    met = links.join(hint_broadcast(described, is_bounded(references, BROADCAST_ROWS)), "row_number")
    return met.groupBy(key).agg(
        F.array_join(F.array_sort(F.collect_set("reference_id")), ";").alias("linked_reference_ids"),
        F.bool_or(F.col("_document") != "").alias("names_a_document"),
        F.bool_or((F.col("_document") != "") & (F.col("_document") == F.col("_own"))).alias("names_own_document"),
        F.bit_or("_bits").alias("metadata_bits"),
    )


def audit_passages(
    measured: DataFrame,
    facts: DataFrame,
    key: str,
    concepts: Concepts = vocab.QUERY_CONCEPTS,
    reasons: str = "text_reasons",
    boilerplate: Column | None = None,
) -> DataFrame:
    """Measured passages with the doubts about their links and their audit class.

    ``measured`` has the measures of :func:`quality.measure` (with ``display_tokens``) and ``reasons``;
    ``facts`` comes from :func:`link_facts`. A passage of another document than all its references
    name is a wrong page; any other doubt sends a clean or merely noisy passage to review. A passage
    without references, or whose references name no document, is no mismatch.
    """
    joined = measured.join(facts, key, "left").withColumn(
        "_named", _bits(lexical.concepts(F.col("display_tokens"), concepts), concepts)
    )
    known = F.coalesce("metadata_bits", F.lit(0))
    doubted = joined.withColumns(
        {
            "linked_reference_ids": F.coalesce("linked_reference_ids", F.lit("")),
            "document_link_mismatch": F.coalesce(F.col("names_a_document") & ~F.col("names_own_document"), F.lit(False)),
            "concept_conflict": (F.col("_named") > 0) & (known > 0) & (F.col("_named").bitwiseAND(known) == 0),
            "passage_concepts": F.array_join(_names(F.col("_named"), concepts), ";"),
            "metadata_concepts": F.array_join(_names(known, concepts), ";"),
        }
    )
    unlinked = F.col("linked_reference_ids") == ""
    flags = ((F.col("document_link_mismatch"), MISMATCH), (F.col("concept_conflict"), CONFLICT), (unlinked, UNLINKED))
    automatic = corpus_audit.audit_class(F.col(reasons), F.col("document_link_mismatch"), boilerplate)
    reasoned = doubted.withColumns(
        {
            "wrong_page_reasons": F.concat_ws(";", *[F.when(flag, F.lit(reason)) for flag, reason in flags]),
            "_class": automatic,
        }
    )
    doubtful = F.col("wrong_page_reasons") != ""
    return (
        reasoned.withColumn("wrong_page_candidate", doubtful)
        .withColumn(
            "audit_class",
            F.when(doubtful & F.col("_class").isin("CLEAN", "READABLE_WITH_LAYOUT_NOISE"), "NEEDS_HUMAN_REVIEW").otherwise(
                F.col("_class")
            ),
        )
        .withColumn(
            "automatic_reason",
            F.coalesce(
                F.nullif(F.array_join(reasons, ";"), F.lit("")),
                F.nullif(F.col("wrong_page_reasons"), F.lit("")),
                F.lit("INTRINSIC_QUALITY_PASS"),
            ),
        )
        .drop("names_a_document", "names_own_document", "metadata_bits", "_named", "_class")
    )


def _mean(millionths: Column) -> Column:
    """Sum of millionths over the rows of a group, half up to six digits; whole numbers, so no order of adding shows."""
    n = F.count("*")
    twice = 2 * millionths + n
    return (twice - F.pmod(twice, 2 * n)) / (2 * n) / MILLION


def source_summary(audited: DataFrame, source: str, page: str, language: str, reasons: str = "text_reasons") -> DataFrame:
    """One row per source: passages, pages, languages, passages per class, quality and doubtful links.

    Pages are counted as one distinct aggregate, which Spark spreads over (source, page), and languages
    are counted per (source, language) first, so no source is gathered in one task. A null source is a
    group of its own; null pages do not count, null languages are left out of the list.
    """
    passing = F.size(reasons) == 0
    totals = audited.groupBy(source).agg(
        F.count("*").alias("n_passages"),
        F.count_distinct(page).alias("n_pages"),
        *[F.count_if(F.col("audit_class") == name).alias("n_" + name.lower()) for name in corpus_audit.CLASSES],
        F.count_if(passing).alias("n_passing"),
        _mean(F.count_if(passing) * MILLION).alias("passing_rate"),
        _mean(F.sum(F.round(F.col("quality_score") * MILLION).cast("long"))).alias("mean_score"),
        F.round(F.min("quality_score"), 6).alias("min_score"),
        F.count_if("wrong_page_candidate").alias("n_wrong_page_candidates"),
    )
    counted = audited.groupBy(source, language).agg(F.count("*").alias("_n"))
    pair = F.when(F.col(language).isNotNull(), F.struct(F.col(language).alias("l"), F.col("_n").alias("n")))
    listed = counted.groupBy(F.col(source).alias("_source")).agg(F.array_sort(F.collect_list(pair)).alias("_pairs"))
    shown = F.array_join(F.transform("_pairs", lambda p: F.concat_ws(":", p["l"], p["n"].cast("string"))), ";")
    return (
        totals.join(listed, F.col(source).eqNullSafe(F.col("_source")))
        .withColumn("language_counts", shown)
        .drop("_source", "_pairs")
    )
