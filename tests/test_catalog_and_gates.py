import pytest
from pyspark.sql import functions as F

from seekgrain.operators import catalog, gates, pool
from seekgrain.presets import BASELINE, SELECTED


@pytest.mark.parametrize(
    "request_,expected",
    [
        ({"period": {"preset": "last_3_years"}}, (2024, 2026)),
        ({"period": {"preset": "last_5_years"}}, (2022, 2026)),
        ({"year_after": 2020}, (2020, 2026)),
        ({"year_before": 2010}, (1900, 2010)),
        ({}, None),
    ],
)
def test_periods(request_, expected):
    assert catalog.resolve_request(request_, 2026).period == expected


@pytest.mark.parametrize(
    "request_",
    [
        {"period": {"preset": "last_3_years", "start_year": 2020}},
        {"period": {"preset": "forever"}},
        {"period": {"start_year": 2020, "end_year": 2010}},
        {"planet": "x"},
        {"project_year": "soon"},
        {"project_year": 1800},
    ],
)
def test_bad_requests(request_):
    with pytest.raises(catalog.FilterError):
        catalog.resolve_request(request_, 2026)


def test_legacy_filters_join_evidence_type():
    request = catalog.resolve_request({"document_type": "CONTRACT", "evidence_type": ["A"]}, 2026)
    assert request.values == {"evidence_type": ["A", "CONTRACT"]}


def test_period_text(value):
    found = value(lambda t: catalog.period(t, 2026), "2022 - Présent")
    assert (found.start_year, found.end_year, found.source_end_year, found.status) == (2022, 2026, 2022, "ongoing")
    assert found.period == "2022–present"
    found = value(lambda t: catalog.period(t, 2026), "2024, 2023")
    assert (found.period, found.status) == ("2023–2024", "completed")
    assert value(lambda t: catalog.period(t, 2026), "12022").status is None


def test_interval_overlap_keeps_open_projects(spark):
    rows = spark.createDataFrame([("a", 2022, 2026), ("b", 2023, 2024), ("c", None, None), ("d", 2010, 2012)], "id string, start_year int, end_year int")
    kept = catalog.apply_filters(rows, catalog.resolve_request({"period": {"preset": "last_3_years"}}, 2026), {})
    assert {r.id for r in kept.collect()} == {"a", "b"}


def test_country(value):
    assert tuple(value(catalog.country, " SENEGAL ")) == ("Sénégal", "SN")
    assert tuple(value(catalog.country, "Atlantis")) == ("Atlantis", None)


def test_unknown_value_is_an_error(spark):
    labels = spark.createDataFrame([("country", "france", "France")], "category string, facet string, value string")
    assert catalog.canonical_values(catalog.FilterRequest({"country": ["FRANCE"]}), labels) == {"country": ["France"]}
    with pytest.raises(catalog.FilterError, match="Unknown country"):
        catalog.canonical_values(catalog.FilterRequest({"country": ["Atlantis"]}), labels)


def test_catalog_normalisation(spark):
    references = spark.createDataFrame(
        [("R1", 1, "Mission API Gateway", "Conseil", "X", "tunisie", "2020-2022", "Sans JUSTIF", True, True)],
        "reference_id string, row_number int, service_nature string, offering string, client string, country string, "
        "project_year string, attestation_available string, evidence_available boolean, document_retrieval_eligible boolean",
    ).withColumns({c: F.lit("") for c in ("reference_number", "sector", "business_unit", "data_quality_status")})
    passages = spark.createDataFrame(
        [("c1", "Audit du réseau VPN", "CONTRACT", "fr-ar", "[1, 1, 9]"), ("c2", "x", "n/a", "en", "broken")],
        "chunk_id string, chunk_text string, document_type string, document_language string, reference_rows_json string",
    )
    links = catalog.bridge(passages.filter("chunk_id = 'c1'"), references, "chunk_id")
    row = catalog.normalize_references(references, links, passages, "chunk_id", 2026).first()
    assert (row.country, row.country_code, row.status) == ("Tunisie", "TN", "completed")
    assert row.technologies == ["API management", "Network"] and row.languages == ["ar", "fr"]
    assert row.evidence_types == ["CONTRACT"]
    assert "Audit technique et organisationnel" in row.key_themes


def test_labels_of_a_text_are_looked_for_once(spark):
    frame = spark.createDataFrame([(" api ", ["B"])], "p string, found array<string>")
    ordered = frame.select(catalog._in_rule_order(F.col("p"), "found", [("A", ["api"]), ("B", ["x"]), ("C", ["y"])]).alias("v"))
    assert ordered.first()["v"] == ["A", "B"]
    plan = ordered._jdf.queryExecution().analyzed().toString()
    assert plan.index("array_union") < plan.index("filter(")


def test_broken_row_list_links_nothing(spark):
    references = spark.createDataFrame([("R1", 1, True)], "reference_id string, row_number int, document_retrieval_eligible boolean")
    passages = spark.createDataFrame([("c2", "broken")], "chunk_id string, reference_rows_json string")
    assert catalog.bridge(passages, references, "chunk_id").isEmpty()


FEATURES = {
    "best_bm25": 0.5, "best_dense": 0.6, "mean_top_dense": 0.6, "best_term_coverage": 0.2, "clean_evidence_passages": 1,
    "independent_passages": 1, "best_evidence_quality": 0.8, "best_selected_dense": 0.6, "cross_language_evidence": False,
    "project_specific_evidence": True, "eligible_chunks": 5, "candidate_references": 1, "meaningful_query_token_count": 2,
    "query_concepts": [], "metadata_compatibility": True, "strong_exact_term_count": 1, "technology_acronym_match_count": 0,
    "capability_field_support": 1, "evidence_field_support": True, "reference_retriever_agreement": 0, "valid_lineage": True,
    "retriever_agreement": 1,
}


def features(spark, **changes):
    row = {**FEATURES, **changes}
    schema = ", ".join(
        f"{k} " + ("array<string>" if isinstance(v, list) else "boolean" if isinstance(v, bool) else "int" if isinstance(v, int) else "double")
        for k, v in FEATURES.items()
    )
    return spark.createDataFrame([tuple(row.values())], schema)


@pytest.mark.parametrize(
    "changes,reason,patterns",
    [
        ({}, "SUFFICIENT_RELEVANCE_AND_EVIDENCE", ["PATTERN_A_STRONG_LEXICAL"]),
        ({"meaningful_query_token_count": 0}, "NO_MEANINGFUL_QUERY_TERMS", None),
        ({"clean_evidence_passages": 0}, "NO_USABLE_EVIDENCE", None),
        ({"valid_lineage": False}, "INVALID_SOURCE_LINEAGE", None),
        ({"query_concepts": ["cloud"], "metadata_compatibility": False}, "CAPABILITY_CONTRADICTION", None),
        ({"best_bm25": 0.1}, "WEAK_LEXICAL_AND_SEMANTIC_SUPPORT", []),
        ({"project_specific_evidence": False}, "GENERIC_OR_BOILERPLATE_EVIDENCE", []),
        ({"best_dense": 0.8, "strong_exact_term_count": 0}, "SUFFICIENT_RELEVANCE_AND_EVIDENCE", ["PATTERN_B_STRONG_SEMANTIC"]),
        ({"strong_exact_term_count": 0, "reference_retriever_agreement": 1}, "SUFFICIENT_RELEVANCE_AND_EVIDENCE", ["PATTERN_C_RETRIEVER_AGREEMENT"]),
        ({"strong_exact_term_count": 0, "capability_field_support": 0, "evidence_field_support": False}, "METADATA_ONLY_MATCH", []),
        ({"strong_exact_term_count": 0}, "SINGLE_ACCIDENTAL_SEMANTIC_NEIGHBOR", []),
        ({"best_term_coverage": 0.05}, "INSUFFICIENT_RELEVANCE_EVIDENCE", []),
    ],
)
def test_relevance(spark, changes, reason, patterns):
    row = gates.decide(features(spark, **changes), SELECTED.relevance).first()
    assert row.relevance_reason == reason
    if patterns is not None:
        assert row.passing_patterns == patterns


@pytest.mark.parametrize(
    "changes,reason",
    [
        ({"best_bm25": 2.0}, "SUFFICIENT_EVIDENCE"),
        ({"eligible_chunks": 0}, "NO_ELIGIBLE_REFERENCE"),
        ({"best_bm25": 0.1, "best_dense": 0.72}, "INSUFFICIENT_LEXICAL_EVIDENCE"),
        ({"best_bm25": 0.1, "best_dense": 0.2}, "INSUFFICIENT_SEMANTIC_EVIDENCE"),
        ({"best_bm25": 2.0, "retriever_agreement": 0}, "LOW_RETRIEVER_AGREEMENT"),
        ({"best_bm25": 4.5, "retriever_agreement": 0}, "SUFFICIENT_EVIDENCE"),
        ({"clean_evidence_passages": 0}, "NO_USABLE_EVIDENCE"),
    ],
)
def test_abstention(spark, changes, reason):
    row = features(spark, **changes).select(gates.abstention_reason(BASELINE.abstention).alias("r")).first()
    assert row.r == reason


@pytest.mark.parametrize(
    "text,reason", [(None, "MALFORMED_QUERY"), ("  ", "EMPTY_QUERY"), ("x" * 1001, "QUERY_TOO_LONG"), ("a\u0001b", "MALFORMED_QUERY"), ("ok", None)]
)
def test_query_problem(value, text, reason):
    assert value(gates.query_problem, text) == reason


def test_aggregation_strategies(spark):
    rows = spark.createDataFrame(
        [(1, "A", "p1", 0.015, 0.9, 0.5, 0.1), (1, "A", "p2", 0.014, 0.8, 0.5, 0.1), (1, "B", "p3", 0.015, 0.9, 0.5, 0.1)],
        "q int, r string, p string, fused double, selection_score double, coverage double, dense double",
    )
    two = gates.best_two(rows, ["q", "r"], "p")
    scores = {r.r: r for r in two.select("r", "supporting_passage", *[gates.strategy_score(s).alias(s) for s in gates.STRATEGIES]).collect()}
    assert scores["A"].C_BEST_PLUS_SUPPORT > scores["B"].C_BEST_PLUS_SUPPORT
    assert scores["A"].supporting_passage == "p2" and scores["B"].supporting_passage is None
    assert scores["A"].B_TOP2_MEAN == pytest.approx(0.0145) and scores["B"].B_TOP2_MEAN == 0.015


def test_pool_priority_leads_with_every_lane(spark):
    rows = spark.createDataFrame(
        [(1, "x", "bm25", 1), (1, "y", "dense", 1), (1, "x", "hybrid", 1), (1, "z", "bm25", 2), (1, "y", "bm25", 3), (1, "w", "dense", 2)],
        "q int, r string, lane string, rank int",
    )
    got = pool.priority(rows, "q", "r", ["bm25", "dense", "hybrid"]).orderBy("pool_position").collect()
    assert [r.r for r in got] == ["x", "y", "w", "z"]  # both rank 2, one lane, no hybrid rank: by id
