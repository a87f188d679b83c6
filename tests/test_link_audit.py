"""Links of passages against the documents and concepts of their references."""

import pytest

from seekgrain.operators import link_audit

CLEAN = dict(
    line_fragmentation=0.0, leading_fragmentation=0.0, repeated_line_ratio=0.0, one_character_token_ratio=0.0,
    suspicious_symbol_ratio=0.0, quality_score=0.9, boilerplate_markers=[], contact_or_signature=False, text_reasons=[],
)
SCHEMA = (
    "chunk_id string, document_id string, reference_rows_json string, display_tokens array<string>, line_fragmentation double, "
    "leading_fragmentation double, repeated_line_ratio double, one_character_token_ratio double, suspicious_symbol_ratio double, "
    "quality_score double, boilerplate_markers array<string>, contact_or_signature boolean, text_reasons array<string>, "
    "source string, page int, lang string, reference_id string"
)
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def passage(chunk, document, rows, tokens="", **changed):
    cells = dict(CLEAN, chunk_id=chunk, document_id=document, reference_rows_json=rows, display_tokens=tokens.split(),
                 source="s", page=1, lang="fr", reference_id="clash") | changed
    return tuple(cells[c] for c in COLUMNS)


REFERENCES = [
    (1, "R1", "D1", "Plan de continuité", "activité bancaire"),
    (2, "R2", "D2", "Cloud public", None),
    (3, "R3", None, "Kong", ""),
    (4, "R4", "", None, None),
]


@pytest.fixture
def references(spark):
    return spark.createDataFrame(
        REFERENCES, "row_number int, reference_id string, canonical_document_id string, service_nature string, offering string"
    )


def audited(spark, references, passages):
    frame = spark.createDataFrame(passages, SCHEMA)
    facts = link_audit.link_facts(frame, references, "chunk_id", "document_id")
    return link_audit.audit_passages(frame, facts, "chunk_id")


PASSAGES = [
    (passage("own", "D1", "[1, 1, 2]"), "R1;R2", "", "CLEAN"),
    (passage("other", "D9", "[1, 2]", "cloud"), "R1;R2", "DOCUMENT_LINK_MISMATCH", "WRONG_PAGE_ASSOCIATION"),
    (passage("no document named", "D9", "[3, 4]", "api management"), "R3;R4", "", "CLEAN"),
    (passage("null document", None, "[2]"), "R2", "DOCUMENT_LINK_MISMATCH", "WRONG_PAGE_ASSOCIATION"),
    (passage("conflict", "D2", "[2]", "le plan continuite est la"), "R2", "DISJOINT_CAPABILITY_CONCEPTS", "NEEDS_HUMAN_REVIEW"),
    (passage("one in common", "D2", "[2, 3]", "cloud pca"), "R2;R3", "", "CLEAN"),
    (passage("both", "D9", "[2]", "kong"), "R2", "DOCUMENT_LINK_MISMATCH;DISJOINT_CAPABILITY_CONCEPTS", "WRONG_PAGE_ASSOCIATION"),
    (passage("unknown", "D1", "[77]"), "", "NO_LINKED_ELIGIBLE_REFERENCE", "NEEDS_HUMAN_REVIEW"),
    (passage("broken", "D1", "[1"), "", "NO_LINKED_ELIGIBLE_REFERENCE", "NEEDS_HUMAN_REVIEW"),
    (passage("null list", "D1", None), "", "NO_LINKED_ELIGIBLE_REFERENCE", "NEEDS_HUMAN_REVIEW"),
    (passage("mixed list", "D1", '["1", "x", null, [2]]'), "R1", "", "CLEAN"),
    (passage("noisy", "D1", "[1]", line_fragmentation=0.3), "R1", "", "READABLE_WITH_LAYOUT_NOISE"),
    (passage("noisy, unlinked", "D1", "[]", line_fragmentation=0.3), "", "NO_LINKED_ELIGIBLE_REFERENCE", "NEEDS_HUMAN_REVIEW"),
    (passage("corrupted, unlinked", "D1", "[]", text_reasons=["OCR_GIBBERISH"]), "", "NO_LINKED_ELIGIBLE_REFERENCE", "CORRUPTED"),
]


def test_doubts_and_classes(spark, references):
    found = {r["chunk_id"]: r for r in audited(spark, references, [p for p, *_ in PASSAGES]).collect()}
    assert len(found) == len(PASSAGES)
    for given, linked, reasons, label in PASSAGES:
        row = found[given[0]]
        assert (row["linked_reference_ids"], row["wrong_page_reasons"], row["audit_class"]) == (linked, reasons, label), given[0]
        assert row["wrong_page_candidate"] == (reasons != "")
    assert found["one in common"]["metadata_concepts"] == "api_management;cloud"
    assert found["one in common"]["passage_concepts"] == "business_continuity;cloud"
    assert found["own"]["automatic_reason"] == "INTRINSIC_QUALITY_PASS"
    assert found["corrupted, unlinked"]["automatic_reason"] == "OCR_GIBBERISH"
    assert found["own"]["reference_id"] == "clash"


def test_a_phrase_over_two_columns_of_one_reference_counts(spark, references):
    row = audited(spark, references, [passage("a", "D1", "[1]", "pca")]).first()
    assert row["metadata_concepts"] == "business_continuity" and not row["concept_conflict"]


def test_both_join_strategies_agree(spark, references, monkeypatch):
    rows = [p for p, *_ in PASSAGES]
    small = audited(spark, references, rows).select("chunk_id", "wrong_page_reasons", "audit_class").collect()
    monkeypatch.setattr(link_audit, "BROADCAST_ROWS", 0)
    assert sorted(small) == sorted(audited(spark, references, rows).select("chunk_id", "wrong_page_reasons", "audit_class").collect())


def test_a_reference_that_every_passage_names(spark, references):
    rows = [passage(f"c{i}", "D1" if i % 2 else "D5", "[1]") for i in range(3000)]
    found = audited(spark, references, rows)
    assert found.filter("document_link_mismatch").count() == 1500


def test_summary_of_sources(spark, references):
    rows = [
        passage("a", "D1", "[1]", page=1), passage("b", "D1", "[1]", page=1, lang="ar"), passage("c", "D9", "[1]", page=2),
        passage("d", "D1", "[1]", page=None, lang=None, text_reasons=["OCR_GIBBERISH"], quality_score=0.1),
        passage("e", "D1", "[]", source=None),
    ]
    summary = link_audit.source_summary(audited(spark, references, rows), "source", "page", "lang")
    found = {r["source"]: r.asDict() for r in summary.collect()}
    assert set(found) == {"s", None}
    s = found["s"]
    assert (s["n_passages"], s["n_pages"], s["n_clean"], s["n_wrong_page_association"], s["n_corrupted"]) == (4, 2, 2, 1, 1)
    assert (s["n_passing"], s["passing_rate"], s["mean_score"], s["min_score"]) == (3, 0.75, 0.7, 0.1)
    assert (s["n_wrong_page_candidates"], s["language_counts"]) == (1, "ar:1;fr:2")
    assert found[None]["n_needs_human_review"] == 1 and found[None]["language_counts"] == "fr:1"


def test_empty_tables(spark, references):
    assert audited(spark, references.limit(0), []).count() == 0
    only = audited(spark, references.limit(0), [passage("a", "D1", "[1]")]).first()
    assert only["wrong_page_reasons"] == "NO_LINKED_ELIGIBLE_REFERENCE"
    assert link_audit.source_summary(audited(spark, references, []), "source", "page", "lang").count() == 0
