"""Corpus versions: review import, policy, quarantine, mapping and eligibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekgrain.functions import text as tx

# Review actions with their (retrieval, display) policy and mapping status.
ACTION_POLICY = {
    "KEEP_RETRIEVAL_AND_DISPLAY": ("YES", "YES"),
    "KEEP_RETRIEVAL_ONLY": ("YES", "NO"),
    "EXCLUDE_GENERIC_OR_NON_EVIDENTIARY_TEXT": ("NO", "NO"),
    "REPAIR_OR_REEXTRACT": ("NO", "NO"),
    "REVIEW_REFERENCE_LINKAGE": ("NO", "NO"),
}
CONFIRMATION = "HUMAN_CONFIRMATION_REQUIRED"
ACTION_STATUS = {
    "KEEP_RETRIEVAL_AND_DISPLAY": "UNCHANGED_RETAINED",
    "KEEP_RETRIEVAL_ONLY": "RETRIEVAL_ONLY",
    "EXCLUDE_GENERIC_OR_NON_EVIDENTIARY_TEXT": "REMOVED_GENERIC",
    "REVIEW_REFERENCE_LINKAGE": "LINKAGE_REVIEW",
    "REPAIR_OR_REEXTRACT": "REPLACED",
}
FOLLOW_UP = (CONFIRMATION, "REVIEW_REFERENCE_LINKAGE")
ALLOWED_VALUES = {
    "approved_for_retrieval": ("YES", "NO"),
    "approved_for_display": ("YES", "NO"),
    "review_confidence": ("HIGH", "MEDIUM", "LOW"),
    "human_wrong_page_judgment": ("YES", "NO", "UNCERTAIN", "NOT_APPLICABLE"),
    "human_coherence_judgment": (
        "COHERENT",
        "INCOHERENT",
        "UNCERTAIN",
        "NOT_APPLICABLE",
        "PARTIALLY_COHERENT",
        "INSUFFICIENT_CONTEXT",
        "COHERENT_BUT_MISASSOCIATED",
    ),
}
HUMAN_CLASSES = (
    "CLEAN",
    "READABLE_WITH_LAYOUT_NOISE",
    "CORRUPTED",
    "INCOHERENT_MIXED_CONTENT",
    "WRONG_PAGE_ASSOCIATION",
    "NEEDS_HUMAN_REVIEW",
)


def yes_no(value: Column) -> Column:
    word = F.upper(tx.strip(F.coalesce(value.cast("string"), F.lit(""))))
    return F.when(word.isin("TRUE", "1", "YES"), "YES").when(word.isin("FALSE", "0", "NO"), "NO").otherwise(word)


def same_value(left: Column, right: Column) -> Column:
    """Numbers equal within 1e-6, otherwise trimmed text equality."""
    a, b = left.try_cast("double"), right.try_cast("double")
    texts = tx.strip(F.coalesce(left, F.lit(""))) == tx.strip(F.coalesce(right, F.lit("")))
    return F.when(a.isNotNull() & b.isNotNull(), F.abs(a - b) <= 1e-6).otherwise(texts)


def formula_like(value: Column) -> Column:
    return F.regexp_like(tx.lstrip(F.coalesce(value, F.lit(""))), F.lit("^[=+@]"))


def resolve_policy(chunks: DataFrame, repaired_pages: DataFrame, review: DataFrame, audit: DataFrame) -> DataFrame:
    """Decision per passage, with the ids that take its place.

    Keys: chunks(chunk_id, document_id, page_number), repaired_pages(document_id, page_number,
    replacement_ids array), review(chunk_id, final_action, approved_for_retrieval,
    approved_for_display), audit(chunk_id, evidence_quality_pass). The ids of a page are as many as its
    new passages; they are joined to the decisions last, so that no other join moves them.
    """
    page = ["document_id", "page_number"]
    ids = repaired_pages.filter("replacement_ids IS NOT NULL")
    ids = ids.select(*page, F.array_join("replacement_ids", ";").alias("_replacements"))
    own = F.when(F.col("approved_for_retrieval"), F.col("chunk_id").cast("string")).otherwise("")
    decided = decide_policy(chunks, repaired_pages, review, audit).join(ids, page, "left")
    return decided.select(
        "chunk_id", *page, "approved_for_retrieval", "approved_for_display", "policy_source", "policy_action", "mapping_status",
        F.coalesce("_replacements", own).alias("new_chunk_ids"),
        F.col("policy_action").isin(*FOLLOW_UP).alias("human_follow_up_required"),
    )


def decide_policy(chunks: DataFrame, repaired_pages: DataFrame, review: DataFrame, audit: DataFrame) -> DataFrame:
    """Decision per passage: a repaired page beats the human review, which beats the audit.

    Takes the tables of ``resolve_policy``; of a repaired page only its mark is joined, not its new ids.
    """
    marks = repaired_pages.filter("replacement_ids IS NOT NULL").select("document_id", "page_number").distinct()
    joined = (
        chunks.join(marks.withColumn("_repaired", F.lit(True)), ["document_id", "page_number"], "left")
        .join(review.select("chunk_id", "final_action", "approved_for_retrieval", "approved_for_display"), "chunk_id", "left")
        .join(audit.select("chunk_id", "evidence_quality_pass"), "chunk_id", "left")
    )
    repaired = F.col("_repaired").isNotNull()
    reviewed = F.col("final_action").isNotNull()
    passed = F.coalesce("evidence_quality_pass", F.lit(False))
    human_keep = yes_no(F.col("approved_for_retrieval")) == "YES"
    status = F.lit(None).cast("string")
    for action, name in ACTION_STATUS.items():
        status = F.when(F.col("final_action") == action, name).otherwise(status)
    status = F.when(
        F.col("final_action") == CONFIRMATION,
        F.when(human_keep, "HUMAN_CONFIRMATION_RETRIEVAL_ONLY").otherwise("HUMAN_CONFIRMATION_QUARANTINE"),
    ).otherwise(status)

    def choose(on_repair: Column, on_review: Column, on_audit: Column) -> Column:
        return F.when(repaired, on_repair).when(reviewed, on_review).otherwise(on_audit)

    no = F.lit(False)
    return joined.select(
        "chunk_id",
        "document_id",
        "page_number",
        choose(no, human_keep, passed).alias("approved_for_retrieval"),
        choose(no, yes_no(F.col("approved_for_display")) == "YES", passed).alias("approved_for_display"),
        choose(
            F.lit("TARGETED_PAGE_REPAIR"), F.lit("HUMAN_REVIEW_FINAL"), F.lit("AUTOMATED_FULL_CORPUS_AUDIT")
        ).alias("policy_source"),
        choose(
            F.lit("REPLACED_BY_REPAIRED_PAGE"),
            F.col("final_action"),
            F.when(passed, "AUTO_QUALITY_PASS").otherwise("AUTO_QUALITY_REJECT"),
        ).alias("policy_action"),
        choose(
            F.lit("REPLACED"),
            status,
            F.when(passed, "UNCHANGED_RETAINED").otherwise("REMOVED_AUTOMATED_QUALITY_GATE"),
        ).alias("mapping_status"),
    )


def split_quarantine(chunks: DataFrame, policy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(retained, quarantined) passages; the latter with their reason."""
    joined = chunks.join(
        policy.select("chunk_id", "approved_for_retrieval", "policy_source", "policy_action", "mapping_status"), "chunk_id"
    )
    kept = joined.filter("approved_for_retrieval")
    out = joined.filter("not approved_for_retrieval").withColumn("quarantine_reason", F.col("mapping_status"))
    return kept, out


def mapping_coverage(chunks: DataFrame, mapping: DataFrame) -> DataFrame:
    """Every old passage must be mapped exactly once."""
    per_chunk = (
        chunks.select("chunk_id")
        .withColumn("n_source", F.lit(1))
        .unionByName(mapping.select("chunk_id").withColumn("n_source", F.lit(0)))
        .groupBy("chunk_id")
        .agg(F.sum("n_source").alias("n_source"), F.count_if(F.col("n_source") == 0).alias("n_mapped"))
    )
    return per_chunk.agg(
        F.count("*").alias("n_chunks"),
        F.count_if((F.col("n_source") == 1) & (F.col("n_mapped") == 1)).alias("n_exactly_once"),
        F.count_if(F.col("n_mapped") == 0).alias("n_unmapped"),
        F.count_if(F.col("n_mapped") > 1).alias("n_repeated"),
        F.count_if(F.col("n_source") == 0).alias("n_unknown"),
    )


def recompute_eligibility(references: DataFrame, surviving_rows: DataFrame) -> DataFrame:
    """A flag survives only where a remaining passage still links the reference."""
    linked = surviving_rows.select("row_number").distinct().withColumn("_linked", F.lit(True))
    joined = references.join(linked, "row_number", "left").withColumn("_linked", F.coalesce("_linked", F.lit(False)))
    return joined.withColumns(
        {
            "document_retrieval_eligible": F.coalesce("document_retrieval_eligible", F.lit(False)) & F.col("_linked"),
            "evidence_available": F.coalesce("evidence_available", F.lit(False)) & F.col("_linked"),
        }
    ).drop("_linked")


def policy_violation(action: Column, retrieval: Column, display: Column) -> Column:
    """The approvals of a review row contradict its action."""
    bad = F.lit(False)
    for name, (expected_retrieval, expected_display) in ACTION_POLICY.items():
        bad = bad | (
            (action == name) & ((retrieval != expected_retrieval) | (display != expected_display))
        )
    return bad | ((action == CONFIRMATION) & (display != "NO"))


def review_checks(review: DataFrame, chunks: DataFrame, references: DataFrame, expected_rows: int | None = None) -> DataFrame:
    """(check_name, n_issues) of a review sheet; any issue means the import fails."""
    known = [*ACTION_POLICY, CONFIRMATION]
    row_checks = {
        "unknown_action": ~F.col("final_action").isin(*known),
        "unknown_classification": ~F.col("human_classification").isin(*HUMAN_CLASSES),
        "policy_violation": policy_violation(
            F.col("final_action"), yes_no(F.col("approved_for_retrieval")), yes_no(F.col("approved_for_display"))
        ),
        "formula_content": formula_like(F.col("human_comments")),
        **{
            f"invalid_{column}": ~yes_no(F.col(column)).isin(*allowed)
            for column, allowed in ALLOWED_VALUES.items()
            if column in review.columns
        },
    }
    expected = F.lit(0) if expected_rows is None else F.abs(F.count("*") - expected_rows)
    one = review.agg(
        expected.alias("row_count"), *[F.count_if(test).alias(name) for name, test in row_checks.items()]
    )
    names = ["row_count", *row_checks]
    table = one.unpivot([], names, "check_name", "n_issues")
    repeated = review.groupBy("chunk_id").agg(F.count("*").alias("n")).filter("n > 1")
    table = table.unionByName(repeated.agg(F.lit("duplicate_chunk").alias("check_name"), F.count("*").alias("n_issues")))
    unknown = review.select("chunk_id").join(chunks.select("chunk_id"), "chunk_id", "left_anti")
    table = table.unionByName(unknown.agg(F.lit("unknown_chunk").alias("check_name"), F.count("*").alias("n_issues")))
    asked = review.select(F.explode(F.split("reference_ids", ";")).alias("reference_id")).filter("reference_id <> ''")
    missing = asked.join(references.select("reference_id"), "reference_id", "left_anti")
    return table.unionByName(
        missing.agg(F.lit("unknown_reference").alias("check_name"), F.count("*").alias("n_issues"))
    )
