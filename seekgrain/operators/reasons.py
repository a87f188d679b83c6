"""Why a result matches: typed reasons with values and a sentence each."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from seekgrain.functions import text as tx

MOST_VALUES = 4

# Reason categories and their sentences; %s takes the values.
TECHNOLOGY = ("Confirmed technology or capability", "Evidence confirms project work involving %s.")
OFFERING = ("Matching offering", "Matches the requested %s offering.")
SECTOR = ("Matching sector", "Relevant experience in the %s sector.")
CAPABILITY = ("Matching capability", "Matches the requested capability: %s.")
SEMANTIC = ("Semantic similarity", "Supporting evidence describes the requested project capability.")
CROSSING = (
    "Cross-language semantic match",
    "Cross-language evidence describes the requested project capability.",
)
DELIVERY = ("Confirmed delivery evidence", "Supporting evidence confirms delivered project services.")
COUNTRY = ("Matching country/filter", "Project country matches the selected filter: %s.")
PERIOD = ("Matching period/filter", "Project period overlaps the selected date range %s.")
EVIDENCE = ("Matching capability", "Selected evidence contains the requested capability: %s.")


def _reason(kind: tuple[str, str], values: Column) -> Column:
    shown = F.array_join(values, ", ")
    sentence = F.format_string(kind[1], shown) if "%s" in kind[1] else F.lit(kind[1])
    return F.struct(F.lit(kind[0]).alias("category"), values.alias("values"), sentence.alias("description"))


def _named(terms: Column, text: Column) -> Column:
    """Display forms of the query terms (struct term, display) that occur as whole tokens of a text."""
    return tx.bind(
        tx.tokens(text),
        lambda found: F.slice(
            F.array_distinct(
                F.transform(F.filter(terms, lambda t: tx.has_phrase(found, t["term"])), lambda t: t["display"])
            ),
            1,
            MOST_VALUES,
        ),
    )


def match_reasons(filters: Mapping[str, object] | None = None, minimum_dense: float = 0.70) -> Column:
    """Reasons of a result row, in a fixed order.

    The row has query_terms (array of struct term, display, category), exact_terms, offering,
    sector, service_nature, best_dense, query_language, evidence_language, display_text,
    citation_label and project_delivery_signal. ``filters`` are the applied ones.
    """
    terms, none = F.col("query_terms"), F.array().cast("array<string>")
    strong = F.filter(
        terms,
        lambda t: t["category"].isin("technology", "acronym") & F.array_contains("exact_terms", t["term"]),
    )
    technologies = F.slice(F.array_distinct(F.transform(strong, lambda t: t["display"])), 1, MOST_VALUES)
    capabilities = _named(terms, F.col("service_nature"))
    crosses = ~F.col("query_language").isin("und", "mixed") & ~(
        F.col("evidence_language").isin("und", "mixed") | (F.col("evidence_language") == F.col("query_language"))
    )
    close = F.col("best_dense") >= minimum_dense
    reasons = [
        F.when(F.size(technologies) > 0, _reason(TECHNOLOGY, technologies)),
        F.when(F.size(_named(terms, F.col("offering"))) > 0, _reason(OFFERING, F.array("offering"))),
        F.when(F.size(_named(terms, F.col("sector"))) > 0, _reason(SECTOR, F.array("sector"))),
        F.when(F.size(capabilities) > 0, _reason(CAPABILITY, capabilities)),
        F.when(close & crosses, _reason(CROSSING, none)).when(close, _reason(SEMANTIC, none)),
        F.when(F.col("project_delivery_signal"), _reason(DELIVERY, F.array("citation_label"))),
    ]
    filters = filters or {}
    if filters.get("country"):
        reasons.append(_reason(COUNTRY, F.array(*[F.lit(str(v)) for v in filters["country"]])))
    if filters.get("period"):
        low, high = filters["period"]
        reasons.append(_reason(PERIOD, F.array(F.lit(f"{low}–{high}"))))
    found = F.array_compact(F.array(*reasons))
    spoken = _named(terms, F.col("display_text"))
    fallback = F.array_compact(F.array(F.when(F.size(spoken) > 0, _reason(EVIDENCE, spoken))))
    return F.when(F.size(found) > 0, found).otherwise(fallback)
