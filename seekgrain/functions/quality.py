"""Text-quality measures of a passage and the evidence gate built on them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekgrain.functions import language, text as tx
from seekgrain.functions import vocabulary as vocab
from seekgrain.operators.lexical import supports_concepts
from seekgrain.presets import EvidenceSettings

UNPRINTABLE = r"[[\p{C}\p{Zl}\p{Zp}\p{Zs}]&&[^ \n\t]]+"
SYMBOL = r"[^\p{L}\p{N}\t-\r\x1c-\x20\x85\p{Z}" + "".join(
    "\\" + c if re.match(r"[\[\]\\^&\-]", c) else c for c in vocab.ALLOWED_SYMBOLS
) + "]+"
SENTENCE_MARK = r"[.!?؟](?:" + tx.SPACE + "|$)"
LEADING_CHARS = 260
FEW_WORDS = 3


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, tx.LINE_BREAK), lambda line: tx.strip(line)), lambda line: line != "")


def _few_words(lines: Column) -> Column:
    return F.size(F.filter(lines, lambda line: F.size(tx.words(line)) <= FEW_WORDS))


def measure(df: DataFrame, raw: str, display: str) -> DataFrame:
    """Add the character, token and line measures. Each stage is a projection of its own, so
    Spark computes every word list and line list once per passage."""
    shape = tx._col
    staged = df.withColumn("_raw", tx.compatible(raw)).withColumn("_shown", F.coalesce(shape(display), F.lit("")))
    staged = staged.withColumns(
        {
            "_words": tx.words("_shown"),
            "_lines": _lines(F.col("_raw")),
            "_lead": _lines(F.left("_raw", F.lit(LEADING_CHARS))),
            "_folded": tx.fold("_shown"),
        }
    )
    # Texts are folded once, and the tokens are words of that form.
    staged = staged.withColumn("display_tokens", F.filter(tx.words("_folded"), lambda t: F.length(t) >= 2))
    staged = staged.withColumn("_content", F.filter("display_tokens", lambda t: ~t.isin(*vocab.STOPWORDS)))
    n_words, n_lines = F.size("_words"), F.size("_lines")
    measured = staged.withColumns(
        {
            "printable_ratio": tx.ratio(
                F.length(F.regexp_replace("_raw", UNPRINTABLE, "")), F.length("_raw")
            ),
            "alphabetic_ratio": tx.ratio(
                F.length(F.regexp_replace("_shown", r"\P{L}+", "")),
                F.length(F.regexp_replace("_shown", tx.SPACE + "+", "")),
            ),
            "meaningful_token_count": F.size("_content"),
            "average_token_length": tx.ratio(F.length(F.array_join("_words", "")), n_words),
            "one_character_token_ratio": tx.ratio(
                F.size(F.filter("_words", lambda w: F.length(w) == 1)), n_words
            ),
            "line_count": n_lines,
            "line_fragmentation": F.when(n_lines >= 3, tx.ratio(_few_words(F.col("_lines")), n_lines)).otherwise(0.0),
            "leading_fragmentation": F.when(
                F.size("_lead") >= 4, tx.ratio(_few_words(F.col("_lead")), F.size("_lead"))
            ).otherwise(0.0),
            "repeated_line_ratio": tx.ratio(
                n_lines - F.size(F.array_distinct(F.transform(F.array_distinct("_lines"), tx.fold))), n_lines
            ),
            "suspicious_symbol_ratio": tx.ratio(
                F.length("_shown") - F.length(F.regexp_replace("_shown", SYMBOL, "")), F.length("_shown")
            ),
            "sentence_completeness": F.least(
                F.lit(1.0),
                F.regexp_count("_shown", F.lit(SENTENCE_MARK)) / F.greatest(F.length("_shown") / 240, F.lit(1.0)),
            ),
            "project_delivery_signal": _any_in(
                F.col("_folded"), ["".join(map(vocab.fold_character, m)) for m in vocab.DELIVERY_MARKERS]
            ),
            "boilerplate_markers": F.array_compact(
                F.array(*[F.when(F.contains("_folded", F.lit(m)), F.lit(m)) for m in vocab.LEGAL_MARKERS])
            ),
            "contact_or_signature": F.regexp_like("_shown", F.lit(vocab.CONTACT_PATTERN)),
            "_lang": language.analyze_composed(F.col("_shown")),
        }
    )
    return measured.withColumns(
        {
            "quality_score": F.round(_score(), 6),
            "evidence_language": F.col("_lang.detected_language"),
            "mixed_script": F.col("_lang.mixed_script"),
            "arabic_ratio": F.col("_lang.arabic_ratio"),
            "latin_ratio": F.col("_lang.latin_ratio"),
        }
    ).drop("_raw", "_shown", "_words", "_content", "_lines", "_lead", "_folded", "_lang")


def _any_in(text: Column, needles) -> Column:
    test = F.lit(False)
    for needle in needles:
        test = test | F.contains(text, F.lit(needle))
    return test


def _score() -> Column:
    def capped(value: Column) -> Column:
        return F.least(value, F.lit(1.0))

    def rest(value: Column) -> Column:
        return F.greatest(F.lit(0.0), 1.0 - value)

    total = (
        0.10 * capped(F.col("printable_ratio"))
        + 0.14 * capped(F.col("alphabetic_ratio") / 0.65)
        + 0.14 * capped(F.col("meaningful_token_count") / 12)
        + 0.08 * capped(F.col("average_token_length") / 5)
        + 0.12 * rest(F.col("one_character_token_ratio"))
        + 0.14 * rest(F.col("line_fragmentation"))
        + 0.08 * rest(F.col("repeated_line_ratio"))
        + 0.08 * rest(F.col("suspicious_symbol_ratio") * 4)
        + 0.12 * F.col("sentence_completeness")
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def text_reasons(s: EvidenceSettings) -> Column:
    """Rejection reasons that need the text alone (no query, no script mix)."""
    gibberish = (
        (F.col("suspicious_symbol_ratio") > s.maximum_symbols)
        | (F.col("leading_fragmentation") > s.maximum_leading_fragmentation)
        | (F.col("alphabetic_ratio") < s.minimum_alphabetic)
        | (F.col("quality_score") < s.minimum_quality)
    )
    return F.array_compact(
        F.array(
            F.when(F.col("meaningful_token_count") < s.minimum_tokens, "TOO_FEW_MEANINGFUL_WORDS"),
            F.when(F.col("line_fragmentation") > s.maximum_line_fragmentation, "EXCESSIVE_FRAGMENTATION"),
            F.when(
                F.col("one_character_token_ratio") > s.maximum_single, "EXCESSIVE_SINGLE_CHARACTER_TOKENS"
            ),
            F.when(F.col("printable_ratio") < s.minimum_printable, "LOW_PRINTABLE_RATIO"),
            F.when(F.col("repeated_line_ratio") > s.maximum_repeated, "REPETITIVE_TEXT"),
            F.when(gibberish, "OCR_GIBBERISH"),
        )
    )


def gate(measured: DataFrame, settings: EvidenceSettings) -> DataFrame:
    """The evidence gate for (query, passage) rows that carry the measures.

    Needs ``query_language``, ``dense``, ``query_tokens`` (meaningful single words) and
    ``query_concepts``; adds ``coverage``, ``rejection_reasons`` and ``quality_pass``.
    """
    return judge(answers(measured), settings)


def answers(rows: DataFrame) -> DataFrame:
    """Adds how far the words of a passage (``display_tokens``) cover the words and concepts of a query."""
    return rows.withColumns(
        {
            "coverage": tx.share_of(F.col("display_tokens"), F.col("query_tokens")),
            "concept_evidence_support": supports_concepts(F.col("query_concepts"), F.col("display_tokens")),
        }
    )


def judge(answered: DataFrame, settings: EvidenceSettings) -> DataFrame:
    """The gate for rows that carry ``answers`` besides the measures; needs no words of the passage."""
    found = F.col("evidence_language")
    crosses = ~F.col("query_language").isin("und", "mixed") & ~(
        found.isin("und", "mixed") | (found == F.col("query_language"))
    )
    judged = answered.withColumn(
        "semantic_cross_language_support",
        crosses & (F.col("dense") >= settings.cross_language_floor) & F.col("project_delivery_signal"),
    )
    incoherent = (
        F.col("mixed_script")
        & (F.least("arabic_ratio", "latin_ratio") >= 0.08)
        & ((F.col("one_character_token_ratio") > 0.18) | (F.col("line_fragmentation") > 0.65))
    )
    unanswered = (
        (F.size("query_tokens") > 0)
        & (F.col("coverage") < settings.minimum_coverage)
        & ~F.col("semantic_cross_language_support")
    ) | ((F.size("query_concepts") > 0) & ~F.col("concept_evidence_support"))
    boilerplate = (F.size("boilerplate_markers") > 0) | F.col("contact_or_signature")
    more = F.array_compact(
        F.array(
            F.when(incoherent, "INCOHERENT_MIXED_SCRIPT"),
            F.when(boilerplate, "LEGAL_OR_CONTACT_BOILERPLATE"),
            F.when(unanswered, "NO_MEANINGFUL_QUERY_EVIDENCE"),
        )
    )
    judged = judged.withColumn("rejection_reasons", F.concat(text_reasons(settings), more))
    return judged.withColumn("quality_pass", F.size("rejection_reasons") == 0)
