"""Batch hybrid search: every stage is a DataFrame, for one query or many."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekgrain.functions import language, text as tx, vocabulary as vocab
from seekgrain.operators import catalog, dense, evidence, fields, gates, lexical, ranking
from seekgrain.presets import SELECTED, Preset
from seekgrain.session import hint_broadcast, is_bounded, reliable_checkpoint, stored

KEY = "chunk_id"


@dataclass(frozen=True)
class Corpus:
    """passages, normalised references, links(chunk_id, reference_id) and, once indexed, the
    term counts and the known phrases of every reference field. ``field_lengths`` has the lengths of the fields
    where the counts are those of some terms only."""

    passages: DataFrame
    references: DataFrame
    links: DataFrame
    field_terms: DataFrame | None = None
    field_phrases: DataFrame | None = None
    field_lengths: DataFrame | None = None
    #: A stored index of all passages (``sinks.read_index``); without one each search tokenises them.
    index: lexical.LexicalIndex | None = None


@dataclass(frozen=True)
class Trace:
    """Every intermediate table of a search, for diagnosis."""

    terms: DataFrame
    field_scores: DataFrame | None
    lexical: DataFrame
    dense: DataFrame
    fused: DataFrame
    groups: DataFrame
    evaluated: DataFrame
    selected: DataFrame
    features: DataFrame
    decided: DataFrame
    results: DataFrame


def query_profile(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """Per query: language, concepts and meaningful single words."""
    kept = terms.filter("status = 'meaningful'").groupBy("query_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("position", "term"))), lambda s: s["term"]
        ).alias("query_tokens")
    )
    blank = F.array().cast("array<string>")
    return (
        queries.join(kept, "query_id", "left")
        .withColumn("query_tokens", F.coalesce("query_tokens", blank))
        .withColumn("_all", tx.tokens("query_text"))
        .withColumn("query_concepts", lexical.concepts(F.col("_all")))
        .withColumn("query_language", language.analyze("query_text")["detected_language"])
        .select("query_id", "query_tokens", "query_concepts", "query_language", "_all")
        .withColumnRenamed("_all", "raw_tokens")
    )


def search(
    corpus: Corpus,
    queries: DataFrame,
    preset: Preset = SELECTED,
    request: catalog.FilterRequest | None = None,
    scope_terms: tuple[str, ...] = (),
) -> Trace:
    """Search ``queries(query_id, query_text, query_vector)``.

    Document frequencies come from the whole corpus; filters only restrict what is ranked. Unusable
    queries (null, empty, too long, control characters) are not scored; ``outcomes`` names them. A
    filter value that the catalog does not know raises an error.
    """
    unindexed = preset.field_scoring and (corpus.field_terms is None or corpus.field_phrases is None)
    queries = queries.filter(gates.query_problem(F.col("query_text"), preset.maximum_query_length).isNull())
    references = corpus.references
    if request is not None:
        refuse_unknown_values(references, request)
        references = catalog.apply_filters(references, request, catalog.standard_facets())
    links = corpus.links.join(references.select("reference_id"), "reference_id", "left_semi")
    eligible = catalog.secured(corpus.passages).join(links.select(KEY).distinct(), KEY, "left_semi")

    tokens = lexical.query_tokens(queries, "query_id", "query_text")
    if corpus.index is not None:
        index = lexical.asked_postings(corpus.index, tokens)
        corpus = index_fields(corpus) if unindexed else corpus
    elif unindexed:
        known = [p for p, _, _ in vocab.PHRASES]
        index = lexical.build_index(corpus.passages, KEY, "chunk_text", tokens, valid_evidence(), known)
        corpus = index_asked_fields(corpus, index, tokens)
    else:
        index = lexical.build_index(corpus.passages, KEY, "chunk_text", tokens)
    terms = lexical.analyze_terms(tokens, index.terms(), "query_id", preset.terms)
    meaningful = terms.filter("status = 'meaningful'").select("query_id", "term", "category")
    profile = reliable_checkpoint(query_profile(queries, terms))

    field_scores = None
    if preset.field_scoring:
        phrases = lexical.phrase_terms(terms, queries, "query_id", "query_text")
        phrases = phrases.select("query_id", "term", "category")
        field_scores = field_lexical(corpus, references, meaningful, phrases, preset, index.few_query_terms)
        field_scores = stored(field_scores)
        open_links = stored(links.join(eligible.select(KEY), KEY, "left_semi"))
        leading = fields.leading_references(field_scores, open_links, "query_id", KEY, preset.depth)
        hits = fields.project_to_passages(leading, open_links, "query_id", KEY)
    else:
        hits = lexical.score(index, meaningful, "query_id", preset.k1, preset.b)
        hits = hits.join(eligible.select(KEY), KEY, "left_semi")

    lane = ranking.zero_filled(hits, queries, eligible, preset.depth, "query_id", KEY)
    lexical_lane = ranking.top_k(lane, ["query_id"], [F.desc("score"), F.col(KEY)], preset.depth, salt_on=KEY)
    dense_lane = dense.score_many(
        eligible, queries, preset.depth, KEY, "embedding", "query_id", "query_vector"
    )
    fused = ranking.fuse(
        lexical_lane, dense_lane, "query_id", KEY, preset.lexical_weight, preset.dense_weight, preset.rrf_k
    )
    fused = ranking.top_k(
        fused, ["query_id"], [F.desc("fused"), F.col(KEY)], preset.depth, "fused_rank", salt_on=KEY
    )
    few_queries = is_bounded(queries, dense.QUERY_BLOCK)
    fused = stored(fused)
    if preset.field_scoring:
        hits = fields.project_to_pairs(fused, field_scores, open_links, "query_id", KEY)
    fused = stored(complete_scores(fused, hits, eligible, queries, few_queries))

    groups = evidence.reference_groups(fused, links, KEY, preset.agreement_depth)
    groups = groups.join(
        evidence.mean_of_best(fused.join(links, KEY), ["query_id", "reference_id"], "dense", 5, KEY),
        ["query_id", "reference_id"],
    )
    groups = stored(groups)
    groups = attach_lane_agreement(groups, field_scores, queries, references, preset.agreement_depth)

    about = reference_text(references)
    pool = stored(evidence.evidence_pool(fused, links, KEY, preset.evidence.pool))
    wanted = corpus.passages.join(pool.select(KEY).distinct(), KEY, "left_semi").drop("embedding")
    measured = stored(evidence.measured_passages(wanted))
    evaluated = stored(
        evidence.evaluate_pool(pool, measured, KEY, preset, hint_broadcast(profile, few_queries), about)
    )
    selected = evidence.select_evidence(evaluated, KEY, preset.evidence)

    features = candidate_features(groups, selected, hint_broadcast(profile, few_queries), about, eligible)
    scope = gates.scope_terms_hit(F.col("raw_tokens"), scope_terms)
    if preset.relevance_gate:
        decided = gates.decide(features, preset.relevance, scope)
    else:
        decided = features.withColumn("passing_patterns", F.array().cast("array<string>"))
        decided = decided.withColumn("relevance_reason", gates.abstention_reason(preset.abstention, scope))
        decided = decided.withColumn("relevant", F.col("relevance_reason") == "SUFFICIENT_EVIDENCE")
    decided = stored(decided)
    results = final_order(decided, selected, preset)
    # Texts to show are joined to the few selected rows only.
    shown = selected.join(measured.select(KEY, "display_text"), KEY)
    return Trace(terms, field_scores, lexical_lane, dense_lane, fused, groups, evaluated, shown, features, decided, results)


def valid_evidence() -> Column:
    """Passages whose text is evidence of the linked references."""
    return F.coalesce("approved_for_retrieval", F.lit(True)) & evidence.lineage_ok()


def index_asked_fields(corpus: Corpus, index: lexical.LexicalIndex, query_terms: DataFrame) -> Corpus:
    """``index_fields`` for one search: only counts of its terms are kept, and passages are not tokenised again."""
    known = [p for p, _, _ in vocab.PHRASES]
    counts = fields.asked_counts(
        fields.own_fields(corpus.references), index.counted, corpus.links, query_terms, known, KEY, index.few_query_terms
    )
    terms, phrases, lengths = fields.told_apart(stored(counts))
    return replace(corpus, field_terms=terms, field_phrases=phrases, field_lengths=lengths)


def index_fields(corpus: Corpus) -> Corpus:
    """Count the terms and find the known phrases of every reference field once, for all later searches."""
    valid = corpus.passages.filter(valid_evidence())
    own = fields.own_fields(corpus.references)
    counts = fields.field_tokens(own, "reference_id").unionByName(
        fields.evidence_tokens(valid, corpus.links, KEY, "chunk_text")
    )
    spoken = fields.field_phrases(own, ["reference_id", "field"], "text").unionByName(
        fields.field_phrases(valid, [KEY], "chunk_text")
        .join(corpus.links, KEY)
        .select("reference_id", F.lit("evidence").alias("field"), "term")
        .distinct()
    )
    return replace(corpus, field_terms=reliable_checkpoint(counts), field_phrases=reliable_checkpoint(spoken))


def refuse_unknown_values(references: DataFrame, request: catalog.FilterRequest) -> None:
    """Raise where a requested value is the label of no reference."""
    facets = catalog.standard_facets()
    asked = [c for c, values in request.values.items() if any(v.strip() for v in values)]
    if not asked:
        return
    rows = None
    for category in asked:
        one = references.select(F.lit(category).alias("category"), F.explode(F.array_compact(facets[category])).alias("value"))
        rows = one if rows is None else rows.unionByName(one)
    labels = rows.withColumn("facet", tx.facet_key("value")).groupBy("category", "facet").agg(F.min("value").alias("value"))
    catalog.canonical_values(request, labels)


def field_lexical(corpus, references, meaningful, phrases, preset: Preset, few: bool) -> DataFrame:
    """Words are scored; words and known phrases give the exact-match bonus."""
    tokens = corpus.field_terms
    scores = fields.score_fields(
        tokens, references, meaningful, "query_id", "reference_id",
        k1=preset.k1, b=preset.b, few_query_terms=few, everything=corpus.references, lengths=corpus.field_lengths,
    )
    present = tokens.select("reference_id", "field", "term").unionByName(corpus.field_phrases)
    asked = meaningful.unionByName(phrases)
    matches = fields.exact_matches(present, references, asked, "query_id", "reference_id", few)
    return fields.combine(scores, matches, "query_id", "reference_id")


def complete_scores(
    fused: DataFrame, hits: DataFrame, eligible: DataFrame, queries: DataFrame, few_queries: bool
) -> DataFrame:
    """Give each fused row both of its scores, also where one lane did not rank it."""
    vectors = queries.select("query_id", "query_vector")
    product = F.round(dense.inner_product(F.col("embedding"), F.col("query_vector")), 6)
    return (
        fused.drop("lexical_score", "dense_score")
        .join(hits.select("query_id", KEY, F.col("score").alias("lexical")), ["query_id", KEY], "left")
        .join(eligible.select(KEY, "embedding"), KEY, "left")
        .join(hint_broadcast(vectors, few_queries), "query_id", "left")
        .withColumn("lexical", F.coalesce("lexical", F.lit(0.0)))
        .withColumn("dense", F.coalesce(product, F.lit(-1.0)))
        .drop("embedding", "query_vector")
    )


def attach_lane_agreement(
    groups: DataFrame, field_scores: DataFrame | None, queries: DataFrame, references: DataFrame, depth: int
) -> DataFrame:
    """1 when both lanes rank the reference within ``depth``: by field score among all eligible
    references, by dense score among the grouped ones."""
    blank = F.array().cast("array<string>")
    if field_scores is None:
        return groups.withColumns(
            {
                "matched_fields": blank,
                "strong_exact_term_count": F.lit(0),
                "technology_acronym_match_count": F.lit(0),
                "capability_field_support": F.lit(0),
                "evidence_field_support": F.lit(False),
                "reference_retriever_agreement": F.lit(0),
            }
        )
    joined = groups.join(field_scores.withColumnRenamed("score", "field_score"), ["query_id", "reference_id"], "left")
    joined = joined.fillna(
        {
            "field_score": 0.0,
            "strong_exact_term_count": 0,
            "technology_acronym_match_count": 0,
            "capability_field_support": 0,
            "evidence_field_support": False,
        }
    ).withColumn("matched_fields", F.coalesce("matched_fields", blank))

    everywhere = ranking.zero_filled(field_scores, queries, references, depth, "query_id", "reference_id")

    def lane(rows: DataFrame, score: str, name: str) -> DataFrame:
        best = ranking.top_k(
            rows.select("query_id", "reference_id", score),
            ["query_id"],
            [F.desc(score), F.col("reference_id")],
            depth,
            "_r",
        )
        return best.select("query_id", "reference_id", F.lit(1).alias(name))

    keys = ["query_id", "reference_id"]
    return (
        joined.join(lane(everywhere, "score", "_f"), keys, "left")
        .join(lane(joined, "best_dense", "_d"), keys, "left")
        .withColumn(
            "reference_retriever_agreement", F.coalesce(F.col("_f") * F.col("_d"), F.lit(0))
        )
        .drop("_f", "_d")
    )


def reference_text(references: DataFrame) -> DataFrame:
    about = F.concat_ws(
        " ",
        *[F.nullif(c, F.lit("")) for c in ("service_nature", "offering", "sector")],
        F.nullif(F.array_join("technologies", " "), F.lit("")),
        F.nullif(F.array_join("key_themes", " "), F.lit("")),
    )
    return references.select(
        "reference_id",
        tx.tokens(about).alias("all_reference_tokens"),
        F.array_distinct(evidence.content_tokens(about)).alias("reference_tokens"),
    )


def candidate_features(groups, selected, profile, about, eligible) -> DataFrame:
    n_eligible = F.lit(eligible.agg(F.count("*").alias("n")).scalar())
    rows = (
        groups.join(evidence.evidence_features(selected), ["query_id", "reference_id"], "left")
        .join(profile, "query_id")
        .join(about.select("reference_id", lexical.supported_concepts(F.col("all_reference_tokens")).alias("_supported")), "reference_id")
        .fillna(
            {
                "best_term_coverage": 0.0,
                "clean_evidence_passages": 0,
                "best_evidence_quality": 0.0,
                "best_selected_dense": -1.0,
                "cross_language_evidence": False,
                "project_specific_evidence": False,
            }
        )
    )
    return rows.withColumns(
        {
            "eligible_chunks": n_eligible,
            "candidate_references": F.lit(1),
            "mean_top_dense": F.coalesce("mean_top_dense", F.lit(-1.0)),
            "independent_passages": F.col("clean_evidence_passages"),
            "meaningful_query_token_count": F.size("query_tokens"),
            "metadata_compatibility": lexical.all_supported(F.col("query_concepts"), F.col("_supported")),
            "evidence_concentration": F.round(F.col("n_rows") / F.greatest(n_eligible, F.lit(1)), 4),
            "valid_lineage": F.col("clean_evidence_passages") > 0,
        }
    ).drop("_supported")


def final_order(decided: DataFrame, selected: DataFrame, preset: Preset) -> DataFrame:
    """Every retained reference of every query, ranked by aggregated score, dense score and id."""
    pairs = gates.best_two(selected, ["query_id", "reference_id"], KEY)
    agreement = F.size(
        F.filter(
            "matched_fields",
            lambda f: f.isin(
                "title", "mission_name", "services_delivered", "description", "technologies", "evidence"
            ),
        )
    )
    scored = decided.filter("relevant").join(pairs, ["query_id", "reference_id"])
    scored = scored.withColumn(
        "reference_score",
        F.round(gates.strategy_score(preset.aggregation, preset.support_bonus, agreement), 8),
    )
    return ranking.row_numbers(
        scored,
        [F.desc("reference_score"), F.desc("best_dense"), F.col("reference_id")],
        "relevance_rank",
        ["query_id"],
    )


def result_page(
    trace: Trace, references: DataFrame, page: int, size: int, mode: str = "relevance", preset: Preset = SELECTED
) -> DataFrame:
    """One page of every query's answer in the order of ``mode``; only here is an answer cut."""
    if not 1 <= size <= preset.largest_page or page < 1:
        raise ValueError(f"pages have 1 to {preset.largest_page} rows and start at 1")
    shown = trace.results
    if mode != "relevance":
        columns = ["start_year", "end_year", "project_title", "client", "country"]
        about = references.select("reference_id", *[c for c in columns if c in references.columns])
        shown = shown.join(about, "reference_id")
    placed = ranking.row_numbers(shown, gates.sort_order(mode), "place", ["query_id"])
    return ranking.page_of(placed, page, size, "place")


def outcomes(queries: DataFrame, trace: Trace, preset: Preset = SELECTED, size: int = 10) -> DataFrame:
    """(query_id, outcome, n_candidates, n_relevant, n_pages) of every query, unusable ones included."""
    found = gates.outcome(trace.decided, "query_id")
    problem = gates.query_problem(F.col("query_text"), preset.maximum_query_length)
    rows = queries.select("query_id", problem.alias("problem")).join(found, "query_id", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_candidates", "n_relevant")})
    return rows.select(
        "query_id",
        F.coalesce("problem", "outcome", F.lit("NO_ELIGIBLE_REFERENCE")).alias("outcome"),
        "n_candidates",
        "n_relevant",
        ranking.page_count(F.col("n_relevant"), size).alias("n_pages"),
    )
