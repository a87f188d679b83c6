import pytest

from seekgrain import contracts
from seekgrain.operators import lifecycle
from seekgrain.plans import corpus_build


def test_policy_order(spark):
    chunks = spark.createDataFrame([(i, "d", i) for i in range(5)], "chunk_id int, document_id string, page_number int")
    repaired = spark.createDataFrame([("d", 0, ["n1", "n2"])], "document_id string, page_number int, replacement_ids array<string>")
    review = spark.createDataFrame(
        [(0, "KEEP_RETRIEVAL_ONLY", "YES", "NO"), (1, "KEEP_RETRIEVAL_ONLY", "true", "0"), (2, "HUMAN_CONFIRMATION_REQUIRED", "no", "no")],
        "chunk_id int, final_action string, approved_for_retrieval string, approved_for_display string",
    )
    audit = spark.createDataFrame([(i, i != 4) for i in range(5)], "chunk_id int, evidence_quality_pass boolean")
    rows = {r.chunk_id: r for r in lifecycle.resolve_policy(chunks, repaired, review, audit).collect()}
    assert (rows[0].policy_source, rows[0].new_chunk_ids) == ("TARGETED_PAGE_REPAIR", "n1;n2")
    assert (rows[1].approved_for_retrieval, rows[1].approved_for_display, rows[1].mapping_status) == (True, False, "RETRIEVAL_ONLY")
    assert (rows[2].mapping_status, rows[2].human_follow_up_required) == ("HUMAN_CONFIRMATION_QUARANTINE", True)
    assert rows[3].mapping_status == "UNCHANGED_RETAINED"
    assert rows[4].mapping_status == "REMOVED_AUTOMATED_QUALITY_GATE"


def test_decisions_carry_no_new_ids(spark):
    chunks = spark.createDataFrame([(0, "d", 0)], "chunk_id int, document_id string, page_number int")
    repaired = spark.createDataFrame([("d", 0, ["n"])], "document_id string, page_number int, replacement_ids array<string>")
    kept = "chunk_id int, final_action string, approved_for_retrieval string, approved_for_display string"
    tables = chunks, repaired, spark.createDataFrame([], kept), spark.createDataFrame([], "chunk_id int, evidence_quality_pass boolean")
    policy = lifecycle.decide_policy(*tables)
    assert "replacement_ids" not in policy.columns and "new_chunk_ids" not in policy.columns
    assert policy.first().mapping_status == "REPLACED"
    whole = lifecycle.resolve_policy(*tables)
    assert whole.first().new_chunk_ids == "n"


def test_build_maps_every_passage_once(spark):
    chunks = spark.createDataFrame(
        [("a", "d", 1, "x"), ("b", "d", 2, "y")], "chunk_id string, document_id string, page_number int, original_text string"
    )
    pages = spark.createDataFrame(
        [("d", 2, "The programme delivered a resilient platform for the bank and trained every regional team. " * 12)],
        "document_id string, page_number int, original_text string",
    )
    repaired = corpus_build.rebuild_chunks(pages)
    review = spark.createDataFrame([], "chunk_id string, final_action string, approved_for_retrieval string, approved_for_display string")
    audit = spark.createDataFrame([("a", True), ("b", True)], "chunk_id string, evidence_quality_pass boolean")
    references = spark.createDataFrame(
        [("R1", 1, True, True), ("R2", 2, True, True)],
        "reference_id string, row_number int, document_retrieval_eligible boolean, evidence_available boolean",
    )
    links = spark.createDataFrame([("a", 1), ("b", 2)], "chunk_id string, row_number int")
    version = corpus_build.build(chunks, repaired, review, audit, references, links)
    kept = {r.chunk_id for r in version.chunks.collect()}
    assert "a" in kept and "b" not in kept and len(kept) == 1 + repaired.count()
    assert lifecycle.mapping_coverage(chunks, version.policy).first().n_exactly_once == 2
    flags = {r.reference_id: r.document_retrieval_eligible for r in version.references.collect()}
    assert flags == {"R1": True, "R2": False}


@pytest.mark.parametrize("raw,expected", [(" true ", "YES"), ("1", "YES"), ("No", "NO"), ("maybe", "MAYBE"), (None, "")])
def test_yes_no(value, raw, expected):
    assert value(lifecycle.yes_no, raw) == expected


@pytest.mark.parametrize("raw,expected", [(" =A1", True), ("@x", True), ("-1", False), (None, False)])
def test_formula_like(value, raw, expected):
    assert value(lifecycle.formula_like, raw) is expected


def test_outer_join_refuses_repeated_keys(spark):
    left = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(contracts.ContractError, match="duplicate key"):
        contracts.one_to_one_outer(left, left.distinct(), ["k"])


def test_contracts(spark):
    rows = spark.createDataFrame([(1, True), (2, None)], "k int, ok boolean")
    with pytest.raises(contracts.ContractError):
        contracts.require_columns(rows, ["k", "z"])
    with pytest.raises(contracts.ContractError):
        contracts.require_true(rows, rows.ok, "not ok")
    assert tuple(contracts.same_keys(rows, rows.filter("k = 1"), "k").first()) == (1, 0, 1)
