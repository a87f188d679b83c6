"""Corpus audit: class of every passage and summary of every source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rejection reasons that mark a passage as corrupted, and audit classes.
SEVERE = (
    "LOW_PRINTABLE_RATIO",
    "OCR_GIBBERISH",
    "EXCESSIVE_SINGLE_CHARACTER_TOKENS",
    "EXCESSIVE_FRAGMENTATION",
    "REPETITIVE_TEXT",
)
CLASSES = (
    "CLEAN",
    "READABLE_WITH_LAYOUT_NOISE",
    "CORRUPTED",
    "WRONG_PAGE_ASSOCIATION",
    "INCOHERENT_MIXED_CONTENT",
    "NEEDS_HUMAN_REVIEW",
)


def audit_class(reasons: Column, wrong_page: Column | None = None, boilerplate: Column | None = None) -> Column:
    """Ordered classes from the measures, the rejection reasons and a document mismatch."""
    noisy = (
        (F.col("line_fragmentation") >= 0.25)
        | (F.col("leading_fragmentation") >= 0.25)
        | (F.col("repeated_line_ratio") >= 0.10)
        | (F.col("one_character_token_ratio") >= 0.12)
        | (F.col("suspicious_symbol_ratio") >= 0.03)
    )
    marked = (
        (F.size("boilerplate_markers") > 0) | F.col("contact_or_signature") if boilerplate is None else boilerplate
    )
    return (
        F.when(F.lit(False) if wrong_page is None else wrong_page, "WRONG_PAGE_ASSOCIATION")
        .when(F.array_contains(reasons, "INCOHERENT_MIXED_SCRIPT"), "INCOHERENT_MIXED_CONTENT")
        .when(F.arrays_overlap(reasons, F.array(*[F.lit(r) for r in SEVERE])), "CORRUPTED")
        .when((F.size(reasons) > 0) | marked | (F.col("quality_score") < 0.57), "NEEDS_HUMAN_REVIEW")
        .when(noisy, "READABLE_WITH_LAYOUT_NOISE")
        .otherwise("CLEAN")
    )


def quality_summary(rows: DataFrame, source: str, language: str, flagged: Column | None = None) -> DataFrame:
    """One row per source. A first aggregate by (source, language) keeps the second one tiny, so a
    source with a third of the corpus is summed in parts. ``flagged`` marks rows to count."""
    def has(reason: str) -> Column:
        return F.count_if(F.array_contains("text_reasons", reason))

    parts = rows.groupBy(source, language).agg(
        F.count("*").alias("n"),
        F.count_if(F.size("text_reasons") == 0).alias("n_passing"),
        has("OCR_GIBBERISH").alias("n_gibberish"),
        has("REPETITIVE_TEXT").alias("n_repetitive"),
        F.count_if(F.lit(False) if flagged is None else flagged).alias("n_flagged"),
        F.sum("quality_score").alias("score_sum"),
        F.min("quality_score").alias("min_score"),
    )
    counts = F.array_sort(F.collect_list(F.struct(F.col(language).alias("l"), F.col("n").alias("n"))))
    return parts.groupBy(source).agg(
        F.sum("n").alias("n_passages"),
        F.count(language).alias("n_languages"),
        *[F.sum(c).alias(c) for c in ("n_passing", "n_gibberish", "n_repetitive", "n_flagged")],
        F.round(F.sum("score_sum") / F.sum("n"), 6).alias("mean_score"),
        F.min("min_score").alias("min_score"),
        F.array_join(F.transform(counts, lambda s: F.concat_ws(":", s["l"], s["n"].cast("string"))), ";").alias(
            "language_counts"
        ),
    )


def worst_sources(summary: DataFrame, n: int = 15) -> DataFrame:
    """The report's top list: most gibberish first."""
    return summary.orderBy(F.desc("n_gibberish"), F.desc("n_repetitive"), F.col("source")).limit(n)
