"""Parts of the search plan on small tables: whole answers, pages, phrases, agreement, refusals."""

import pytest
from pyspark.sql import functions as F

from seekgrain.functions import quality
from seekgrain.operators import catalog, evidence, fields, grounding, lexical, metrics, pool
from seekgrain.plans import search as plan
from seekgrain.presets import SELECTED
from seekgrain.sources import sinks


def test_an_answer_has_every_retained_reference(spark):
    keys = [("q1", f"r{i:05d}") for i in range(1300)] + [("q2", "r00001")]
    decided = spark.createDataFrame(keys, "query_id string, reference_id string").withColumns(
        {"relevant": F.lit(True), "matched_fields": F.array().cast("array<string>"), "best_dense": F.lit(0.1), "best_fused": F.lit(0.5)}
    )
    selected = decided.select(
        "query_id", "reference_id", F.lit(1).cast("long").alias("chunk_id"), F.lit(0.5).alias("fused"), F.lit(0.4).alias("selection_score"),
        F.lit(0.2).alias("dense"), F.lit(0.3).alias("coverage"), F.lit(0.9).alias("quality_score"),
    )
    results = plan.final_order(decided, selected, SELECTED)
    assert sorted(r.relevance_rank for r in results.filter("query_id = 'q1'").collect()) == list(range(1, 1301))


def test_pages(spark):
    results = spark.createDataFrame([("q", f"r{i:04d}", i + 1) for i in range(700)], "query_id string, reference_id string, relevance_rank long")
    references = spark.createDataFrame(
        [(f"r{i:04d}", 1990 + i % 30, 2000 + i % 20, "t", "c", "k") for i in range(700)],
        "reference_id string, start_year int, end_year int, project_title string, client string, country string",
    )
    trace = plan.Trace(*[None] * 10, results)
    last = plan.result_page(trace, references, 14, 50)
    assert [r.relevance_rank for r in last.orderBy("place").collect()] == list(range(651, 701))
    newest = plan.result_page(trace, references, 1, 10, "newest").orderBy("place").collect()
    assert [r.end_year for r in newest] == [2019] * 10 and [r.relevance_rank for r in newest] == sorted(r.relevance_rank for r in newest)
    with pytest.raises(ValueError):
        plan.result_page(trace, references, 1, 501)


def test_outcomes(spark):
    queries = spark.createDataFrame([(1, "ok"), (2, " "), (3, None), (4, "x" * 1001), (5, "no")], "query_id int, query_text string")
    decided = spark.createDataFrame([(1, True, "S"), (1, False, "W")], "query_id int, relevant boolean, relevance_reason string")
    trace = plan.Trace(*[None] * 9, decided, None)
    got = {r.query_id: (r.outcome, r.n_relevant, r.n_pages) for r in plan.outcomes(queries, trace).collect()}
    assert got == {
        1: ("SUFFICIENT_EVIDENCE", 1, 1), 2: ("EMPTY_QUERY", 0, 0), 3: ("MALFORMED_QUERY", 0, 0),
        4: ("QUERY_TOO_LONG", 0, 0), 5: ("NO_ELIGIBLE_REFERENCE", 0, 0),
    }


def test_agreement_ranks_all_eligible_references(spark):
    queries = spark.createDataFrame([(1,)], "query_id int")
    references = spark.createDataFrame([(f"r{i}",) for i in range(6)], "reference_id string")
    scores = spark.createDataFrame(
        [(1, f"r{i}", 5.0 - i, [], 0, 0, 0, False) for i in range(4)],
        "query_id int, reference_id string, score double, matched_fields array<string>, strong_exact_term_count int, "
        "technology_acronym_match_count int, capability_field_support int, evidence_field_support boolean",
    )
    groups = spark.createDataFrame([(1, "r3", 0.9), (1, "r1", 0.8)], "query_id int, reference_id string, best_dense double")
    got = plan.attach_lane_agreement(groups, scores, queries, references, 2).collect()
    assert {r.reference_id: r.reference_retriever_agreement for r in got} == {"r3": 0, "r1": 1}


def test_phrases_match_adjacent_words(spark):
    rows = spark.createDataFrame([(1, "Core Banking migration"), (2, "banking core"), (3, None)], "id int, text string")
    found = {(r.id, r.term) for r in fields.field_phrases(rows, ["id"], "text").collect()}
    assert (1, "core banking") in found and not any(i != 1 for i, _ in found)


def test_empty_references_count(spark):
    tokens = spark.createDataFrame([("a", "title", "x", 1), ("b", "title", "y", 1)], "k string, field string, term string, tf long")
    everyone = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "k string")
    asked = spark.createDataFrame([(1, "x")], "q int, term string")
    small = fields.score_fields(tokens, everyone, asked, "q", "k").first()["raw"]
    large = fields.score_fields(tokens, everyone, asked, "q", "k", everything=everyone).first()["raw"]
    assert large != small
    for few in (True, False):
        assert fields.score_fields(tokens, everyone, asked, "q", "k", few_query_terms=few).first()["raw"] == small


def test_unknown_filter_values_are_refused(spark):
    facets = catalog.standard_facets()
    assert "country" in facets
    references = spark.createDataFrame([("r1", "Mali")], "reference_id string, country string")
    plan.refuse_unknown_values(references, catalog.FilterRequest({"country": ["mali"]}))
    with pytest.raises(catalog.FilterError, match="Unknown country"):
        plan.refuse_unknown_values(references, catalog.FilterRequest({"country": ["Atlantis"]}))


def test_a_missing_hybrid_rank_sorts_last(spark):
    rows = [(1, "a", "bm25", 7), (1, "a", "hybrid", 1500), (1, "b", "bm25", 7), (1, "b", "dense", 1600), (1, "z", "bm25", 1), (1, "y", "dense", 1), (1, "x", "hybrid", 1)]
    lanes = spark.createDataFrame(rows, "q int, item string, lane string, rank int")
    got = [r.item for r in pool.priority(lanes, "q", "item", ["bm25", "dense", "hybrid"]).orderBy("pool_position").collect()]
    assert got == ["z", "y", "x", "a", "b"]


def test_unavailable_fields_stay_empty(spark):
    supports = spark.createDataFrame(
        [("r1", "s1", [grounding.COMPLETED], "done", None), ("r2", "s2", [grounding.COMPLETED], "done", None)],
        "reference_id string, support_id string, support_types array<string>, text string, fact_field string",
    )
    gone = spark.createDataFrame([("r1", "completed_work_details"), ("r2", "unheard of")], "reference_id string, source_field string")
    got = {(r.reference_id, r.field) for r in grounding.field_plan(supports, gone).collect()}
    assert ("r1", "realisations") not in got and ("r2", "realisations") in got and ("r1", "contribution") in got


def test_known_facts_may_come_from_the_records(spark):
    claims = spark.createDataFrame([(1, "r1", "Work in Wonderland in 2019"), (2, "r1", "Work in Wonderland")], "claim_id int, reference_id string, text string")
    known = spark.createDataFrame([("country", "Wonderland"), ("project_year", "2019")], "field string, value string")
    facts = spark.createDataFrame([("r1", "nothing")], "reference_id string, fact_text string")
    backing = spark.createDataFrame([(2, "a mission in wonderland")], "claim_id int, support_text string")
    got = {(r.claim_id, r.code) for r in grounding.unknown_facts(claims, known, facts, backing=backing).collect()}
    assert got == {(1, "UNSUPPORTED_COUNTRY"), (1, "UNSUPPORTED_YEAR")}


def test_quantiles_of_one_value(spark):
    frame = spark.createDataFrame([("a", 0.0)] * 500 + [("a", 1.0)] * 3, "k string, v double")
    row = metrics.quantiles_by(frame, ["k"], "v", p50=0.5, top=1.0).first()
    assert (row.p50, row.top) == (0.0, 1.0)


def test_a_stored_index_scores_like_a_fresh_one(spark, tmp_path):
    docs = spark.createDataFrame([(0, "Kong API gateway for a bank"), (1, "API strategy"), (2, "network audit"), (3, "")], "doc_id long, text string")
    asked = lexical.query_tokens(spark.createDataFrame([(1, "API gateway"), (2, "audit")], "q int, t string"), "q", "t")
    sinks.write_index(lexical.build_index(docs, "doc_id", "text"), str(tmp_path / "index"))
    stored = lexical.asked_postings(sinks.read_index(spark, str(tmp_path / "index"), "doc_id"), asked)
    fresh = lexical.build_index(docs, "doc_id", "text", asked)
    assert "text" not in stored.postings.columns and stored.postings.count() == 4

    def pick(index):
        scores = sorted(map(tuple, lexical.score(index, asked.select("q", "term"), "q").collect()))
        return scores, sorted(map(tuple, index.terms().collect()))

    assert pick(stored) == pick(fresh)


def test_pool_rows_carry_no_words(spark):
    pool = spark.createDataFrame(
        [(1, "a", "c1", 0.1, 0.5), (1, "b", "c1", 0.1, 0.5), (2, "a", "c1", 0.1, 0.5)],
        "query_id int, reference_id string, chunk_id string, fused double, dense double",
    )
    passages = spark.createDataFrame([("c1", "The programme delivered a resilient platform for every regional team.")], "chunk_id string, t string")
    measured = quality.measure(passages.withColumn("display_text", F.col("t")), "t", "display_text").drop("t")
    profile = spark.createDataFrame(
        [(1, ["resilient", "bank"], [], "en"), (2, ["platform"], [], "en")],
        "query_id int, query_tokens array<string>, query_concepts array<string>, query_language string",
    )
    about = spark.createDataFrame([("a", ["team", "x"]), ("b", [])], "reference_id string, reference_tokens array<string>")
    rows = evidence.evaluate_pool(pool, measured, "chunk_id", SELECTED, profile, about)
    got = {(r.query_id, r.reference_id): (r.coverage, r.metadata_support) for r in rows.collect()}
    assert got == {(1, "a"): (0.5, 0.5), (1, "b"): (0.5, 0.0), (2, "a"): (1.0, 0.5)}
    assert not {"display_text", "display_tokens", "query_tokens", "reference_tokens"} & set(rows.columns)
