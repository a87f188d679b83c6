"""Audit of passages against the documents and concepts of the references they are linked to.

A document is the passage, its source stands for the document it was cut from, and the parts of the
order with its number are its references; a part belongs to the source of the document with its own number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekgrain.operators import corpus_audit, link_audit
from suite.base import Tables, query, sql_list, sql_tokens
from suite.texts import QUALITY_SQL, measured

#: Words and phrases of the given tables' invented prose, in place of capability concepts.
CONCEPTS = {"likely": ("thble", "thing", "the thble"), "moving": ("ertion", "ontion"), "telling": ("nicht", "mente")}


def audited(t: Tables) -> DataFrame:
    about = t.documents.select(F.col("doc_id").alias("p_partkey"), "text", "source")
    references = t.part.join(about, "p_partkey", "left").select(
        F.col("p_partkey").cast("int").alias("row_number"),
        F.format_string("R%09d", "p_partkey").alias("reference_id"),
        F.col("source").alias("canonical_document_id"),
        F.col("text").alias("service_nature"),
        F.col("p_type").alias("offering"),
    )
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("doc_id")).agg(
        F.to_json(F.collect_set("l_partkey")).alias("reference_rows_json")
    )
    passages = t.documents.select("doc_id", "source").join(rows, "doc_id")
    facts = link_audit.link_facts(passages, references, "doc_id", "source", CONCEPTS)
    return link_audit.audit_passages(measured(t), facts, "doc_id", CONCEPTS)


def _bits(tokens: str) -> str:
    padded = f"(' ' || array_to_string({tokens}, ' ') || ' ')"
    tests = [
        f"CASE WHEN {' OR '.join(f'''contains({padded}, ' {p} ')''' for p in phrases)} THEN {1 << place} ELSE 0 END"
        for place, phrases in enumerate(CONCEPTS.values())
    ]
    return " + ".join(tests)


def _shown(bits: str) -> str:
    cells = ", ".join(f"CASE WHEN ({bits} & {1 << place}) > 0 THEN '{name}' END" for place, name in enumerate(CONCEPTS))
    return f"array_to_string(list_filter([{cells}], lambda c: c IS NOT NULL), ';')"


AUDIT_SQL = f"""WITH {QUALITY_SQL}, refs AS (SELECT p_partkey, printf('R%09d', p_partkey) AS reference_id, coalesce(source, '') AS owner,
    {_bits(sql_tokens("concat_ws(' ', text, p_type)"))} AS bits FROM part LEFT JOIN documents ON doc_id = p_partkey),
  facts AS (SELECT doc_id, string_agg(DISTINCT reference_id, ';' ORDER BY reference_id) AS linked_reference_ids,
    bool_or(owner <> '') AND NOT bool_or(owner <> '' AND owner = coalesce(source, '')) AS mismatch, bit_or(bits) AS bits
    FROM documents JOIN lineitem ON l_orderkey = doc_id JOIN refs ON p_partkey = l_partkey GROUP BY doc_id),
  doubts AS (SELECT r.*, coalesce(linked_reference_ids, '') AS linked_reference_ids, coalesce(mismatch, false) AS document_link_mismatch,
    {_bits('toks')} AS own_bits, coalesce(bits, 0) AS ref_bits FROM reasons r LEFT JOIN facts USING (doc_id)),
  judged AS (SELECT *, own_bits > 0 AND ref_bits > 0 AND (own_bits & ref_bits) = 0 AS concept_conflict,
    CASE WHEN document_link_mismatch THEN 'WRONG_PAGE_ASSOCIATION'
      WHEN len(list_filter(text_reasons, lambda x: list_contains({sql_list(corpus_audit.SEVERE)}, x))) > 0 THEN 'CORRUPTED'
      WHEN len(text_reasons) > 0 OR n_boilerplate > 0 OR contact_or_signature OR quality_score < 0.57 THEN 'NEEDS_HUMAN_REVIEW'
      WHEN line_fragmentation >= 0.25 OR leading_fragmentation >= 0.25 OR repeated_line_ratio >= 0.10
        OR one_character_token_ratio >= 0.12 OR suspicious_symbol_ratio >= 0.03 THEN 'READABLE_WITH_LAYOUT_NOISE'
      ELSE 'CLEAN' END AS found_class FROM doubts),
  audited AS (SELECT *, document_link_mismatch OR concept_conflict OR linked_reference_ids = '' AS wrong_page_candidate,
    CASE WHEN wrong_page_candidate AND found_class IN ('CLEAN', 'READABLE_WITH_LAYOUT_NOISE') THEN 'NEEDS_HUMAN_REVIEW'
      ELSE found_class END AS audit_class, concat_ws(';', CASE WHEN document_link_mismatch THEN '{link_audit.MISMATCH}' END,
      CASE WHEN concept_conflict THEN '{link_audit.CONFLICT}' END, CASE WHEN linked_reference_ids = '' THEN '{link_audit.UNLINKED}' END)
      AS wrong_page_reasons FROM judged)"""


@query(
    "link_audit",
    f"""{AUDIT_SQL} SELECT doc_id, linked_reference_ids, document_link_mismatch, concept_conflict, wrong_page_candidate,
    wrong_page_reasons, {_shown('own_bits')} AS passage_concepts, {_shown('ref_bits')} AS metadata_concepts, audit_class FROM audited""",
)
def _(t: Tables) -> DataFrame:
    return audited(t).select(
        "doc_id", "linked_reference_ids", "document_link_mismatch", "concept_conflict", "wrong_page_candidate",
        "wrong_page_reasons", "passage_concepts", "metadata_concepts", "audit_class",
    )


@query(
    "source_audit",
    f"""{AUDIT_SQL}, l AS (SELECT source, string_agg(lang || ':' || n, ';' ORDER BY lang) AS language_counts FROM
      (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source)
    SELECT a.source, count(*) AS n_passages, count(DISTINCT a.doc_id // 3) AS n_pages,
    {', '.join(f"count(*) FILTER (audit_class = '{c}') AS n_{c.lower()}" for c in corpus_audit.CLASSES)},
    count(*) FILTER (len(text_reasons) = 0) AS n_passing, (2000000 * count(*) FILTER (len(text_reasons) = 0) + count(*)) // (2 * count(*)) / 1000000 AS passing_rate,
    (2 * sum(round(quality_score * 1000000)::BIGINT)::BIGINT + count(*)) // (2 * count(*)) / 1000000 AS mean_score, round(min(quality_score), 6) AS min_score,
    count(*) FILTER (wrong_page_candidate) AS n_wrong_page_candidates, any_value(l.language_counts) AS language_counts
    FROM audited a JOIN l ON a.source IS NOT DISTINCT FROM l.source GROUP BY a.source""",
)
def _(t: Tables) -> DataFrame:
    """Three neighbouring documents stand for the passages of one page."""
    rows = audited(t).join(t.documents.select("doc_id", "lang"), "doc_id")
    return link_audit.source_summary(rows.withColumn("page", F.expr("doc_id div 3")), "source", "page", "lang")
