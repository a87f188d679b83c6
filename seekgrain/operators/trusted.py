"""Trusted references for export: rejection codes, ordered evidence, fragments and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekgrain.functions import display, text as tx
from seekgrain.operators.ranking import top_k
from seekgrain.session import reliable_checkpoint

SHA_PATTERN = "^[0-9a-f]{64}$"
# Administrative wording, where a source text is split, and project openings.
BOILERPLATE_PATTERN = (
    r"(?iU)\bje soussign[ée]\b|\batteste(?: par la pr[ée]sente)?\b|\bcertifie(?: par la pr[ée]sente)?\b|"
    r"\ben foi de quoi\b|\bservir et valoir ce que de droit\b|\bfait [àa]\b|\bsignature\b|\bt[ée]l(?:[ée]phone)?\b|"
    r"\be[- ]?mail\b|\badresse\b|\bcontrat n[°o]\b|\battestation (?:de|du|d['’])\b|\bpleine satisfaction\b|\[PHONE_LIKE\]"
)
FRAGMENT_SPLIT = r"(?U)(?=[\s•▪◦;])(?:\r?\n|[•▪◦]|\s+[–—-]\s+|;\s+|(?<=[.!?])\s+)"
PROJECT_OPENING = r"(?iu)le projet|la mission|l’étude|l'etude"
FRAGMENT_EDGE = " \t\r\n•▪◦-–—:;"
SHORTEST = 12
#: A value that ``text.clean`` leaves empty, told from its first characters.
MISSING = "(?i)^" + tx.SPACE + "*(?:" + "|".join(tx.NULL_WORDS) + ")" + tx.SPACE + r"*\z"


def lineage_valid() -> Column:
    def present(name: str) -> Column:
        return ~F.regexp_like(F.coalesce(F.col(name).cast("string"), F.lit("")), F.lit(MISSING))

    return (
        present("document_id")
        & present("source_file_name")
        & F.regexp_like(F.lower(tx.clean("source_sha256")), F.lit(SHA_PATTERN))
        & (F.col("page_number_1_based") > 0)
        & present("citation_label")
        & present("citation_uri")
        & present("display_text")
    )


def rejection_codes(
    references: DataFrame, passages: DataFrame, links: DataFrame, quarantined_rows: DataFrame, allowed: list[str]
) -> DataFrame:
    """(reference_id, code): the first check a reference fails, or null when it can be exported.

    A passage is checked once, whatever the number of its links, and its texts meet none of them. Passage
    facts are aggregated per reference before anything is joined back. links has (chunk_id, row_number).
    """
    open_to_user = F.col("security_classification").isin(*allowed)
    shown = open_to_user & F.coalesce("approved_for_display", F.lit(False))
    checked = passages.select(
        "chunk_id", "document_id", "source_sha256",
        F.coalesce("approved_for_retrieval", F.lit(False)).alias("_approved"),
        open_to_user.alias("_open"),
        shown.alias("_shown"),
        F.when(shown, F.coalesce(lineage_valid(), F.lit(False))).alias("_valid"),
    )
    # Written once: the optimiser would move the checks behind a join.
    linked_passages = links.join(reliable_checkpoint(checked), "chunk_id")
    facts = linked_passages.groupBy("row_number").agg(
        F.count("*").alias("n_linked"),
        F.count_if(~F.col("_approved")).alias("n_unapproved"),
        F.count_if("_open").alias("n_open"),
        F.count_if("_shown").alias("n_shown"),
        F.count_if(F.col("_shown") & ~F.col("_valid")).alias("n_bad_lineage"),
    )
    hashes = (
        linked_passages.filter("_shown")
        .groupBy("row_number", "document_id")
        .agg(F.count_distinct(F.lower("source_sha256")).alias("n_hashes"))
        .groupBy("row_number")
        .agg(F.max("n_hashes").alias("n_hashes"))
    )
    set_aside = quarantined_rows.select("row_number").distinct().withColumn("_aside", F.lit(True))
    counted = references.groupBy("reference_id").agg(F.count("*").alias("_copies"))
    joined = (
        references.join(counted, "reference_id")
        .join(facts, "row_number", "left")
        .join(hashes, "row_number", "left")
        .join(set_aside, "row_number", "left")
    )
    linked = F.coalesce("n_linked", F.lit(0))
    code = (
        F.when(F.col("_copies") > 1, "AMBIGUOUS_REFERENCE_ID")
        .when(
            ~F.coalesce("document_retrieval_eligible", F.lit(False)),
            F.when(F.col("_aside") & (linked == 0), "REFERENCE_QUARANTINED").otherwise("REFERENCE_NOT_RETRIEVAL_APPROVED"),
        )
        .when(linked == 0, "REFERENCE_WITHOUT_EVIDENCE")
        .when(F.col("n_unapproved") > 0, "REFERENCE_NOT_RETRIEVAL_APPROVED")
        .when(F.col("n_open") == 0, "REFERENCE_NOT_AUTHORIZED")
        .when(F.col("n_shown") == 0, "DISPLAY_EVIDENCE_REQUIRED")
        .when(F.col("n_bad_lineage") > 0, "INVALID_SOURCE_LINEAGE")
        .when(F.col("n_hashes") > 1, "SOURCE_HASH_MISMATCH")
    )
    return joined.select("reference_id", code.alias("code"))


def selection_problems(selected: DataFrame, references: DataFrame) -> DataFrame:
    """Repeated and unknown ids of a selection: (reference_id, code)."""
    repeated = selected.groupBy("reference_id").agg(F.count("*").alias("n")).filter("n > 1")
    unknown = selected.select("reference_id").distinct().join(references.select("reference_id"), "reference_id", "left_anti")
    return repeated.select("reference_id", F.lit("DUPLICATE_REFERENCE_ID").alias("code")).unionByName(
        unknown.select("reference_id", F.lit("UNKNOWN_REFERENCE_ID").alias("code"))
    )


def source_documents(evidence: DataFrame) -> DataFrame:
    """Each source document once, with its pages."""
    pages = evidence.select("document_id", "source_sha256", "page_number_1_based").distinct()
    return pages.groupBy("document_id", "source_sha256").agg(
        F.count("*").alias("n_pages"), F.sort_array(F.collect_list("page_number_1_based")).alias("pages")
    )


def first_evidence(evidence: DataFrame, chosen: DataFrame) -> DataFrame:
    """Per reference the first evidence the narrative cites, else the first display evidence.

    evidence: reference_id, chunk_id, position; chosen: reference_id, chunk_id, support_order.
    """
    joined = evidence.join(chosen, ["reference_id", "chunk_id"], "left")
    order = [F.col("support_order").asc_nulls_last(), F.col("position"), F.col("chunk_id")]
    return top_k(joined, ["reference_id"], order, 1, "_r").drop("_r")


def _first_of_equal(values: Column, key) -> Column:
    """Values in order, of those with an equal key the first one; sorted, not looked up, as a text has thousands."""
    keyed = F.array_sort(F.transform(values, lambda v, i: F.struct(key(v).alias("k"), i.alias("i"), v.alias("v"))))
    first = tx.bind(keyed, lambda a: F.filter(a, lambda s, i: (i == 0) | (F.get(a, i - 1)["k"] != s["k"])))
    return F.transform(F.array_sort(F.transform(first, lambda s: F.struct(s["i"], s["v"]))), lambda s: s["v"])


def safe_fragments(text: Column, maximum: int) -> Column:
    """Source fragments fit to show: split, tidied, without administrative wording or repeats.

    Fragments are searched for that wording only where the text as a whole, its white space squeezed, has some.
    """

    def tidy(part: Column) -> Column:
        return F.trim(tx.squeeze(part), F.lit(FRAGMENT_EDGE))

    def is_boilerplate(item: Column) -> Column:
        return F.regexp_like(item, F.lit(BOILERPLATE_PATTERN))

    def project_part(item: Column) -> Column:
        """What a fragment with administrative wording says from its project opening on, null without one."""
        rest = tx.bind(
            F.regexp_instr(item, F.lit(PROJECT_OPENING)),
            lambda at: F.when(at > 0, F.substring(item, at, F.length(item))),
        )
        return tx.bind(rest, lambda r: F.when(~is_boilerplate(r), r))

    def fit(item: Column) -> Column:
        clauses = F.filter(
            F.transform(F.split(item, r"(?U)(?<=,)|\s*:\s*"), tidy),
            lambda c: F.length(c).between(SHORTEST, maximum),
        )
        return F.when(F.length(item) > maximum, F.coalesce(F.get(clauses, F.lit(0)), F.lit(""))).otherwise(item)

    def fragments(cleaned: Column) -> Column:
        parts = F.transform(F.split(cleaned, FRAGMENT_SPLIT), tidy)
        proper = F.when(
            is_boilerplate(tx.squeeze(cleaned)),
            F.transform(parts, lambda p: F.when(is_boilerplate(p), project_part(p)).otherwise(p)),
        ).otherwise(parts)
        usable = F.filter(proper, lambda p: F.coalesce(F.length(p) >= SHORTEST, F.lit(False)))
        return F.filter(F.transform(usable, fit), lambda p: p != "")

    return _first_of_equal(tx.bind(display.clean_display(text), fragments), F.lower)


def excerpt(fragments: Column, maximum: int) -> Column:
    """Join fragments in order, skipping one that would not fit."""
    return F.aggregate(
        fragments,
        F.lit(""),
        lambda acc, p: F.when(acc == "", F.when(F.length(p) <= maximum, p).otherwise(acc))
        .when(F.length(acc) + 1 + F.length(p) <= maximum, F.concat(acc, F.lit(" "), p))
        .otherwise(acc),
    )


def prepared_bullets(own: Column, evidence: Column, least: int = 3, most: int = 6) -> Column:
    """Own fragments first; evidence fills up to ``least``; at most ``most`` in all."""
    filled = F.concat(own, F.slice(F.array_except(evidence, own), F.lit(1), F.greatest(F.lit(least) - F.size(own), F.lit(0))))
    return F.slice(F.array_distinct(filled), 1, most)
