"""Corpus versions, reviews, pools and set operations over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekgrain import contracts
from seekgrain.functions import documents, lists
from seekgrain.operators import corpus_audit, lifecycle, pool, ranking
from seekgrain.session import reliable_checkpoint
from suite.base import Tables, query, sql_list
from suite.retrieval import lanes, sql_fused
from suite.texts import QUALITY_SQL, measured

ACTIONS = (*lifecycle.ACTION_POLICY, lifecycle.CONFIRMATION)


def chunk_table(t: Tables) -> DataFrame:
    return t.documents.select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), (F.col("n_chars") % 40).alias("page_number")
    )


def review_table(t: Tables) -> DataFrame:
    """Labels read as a review sheet: the action follows the document, approvals follow the labels."""
    action = F.get(F.array(*[F.lit(a) for a in ACTIONS]), F.pmod("doc_id", F.lit(len(ACTIONS))).cast("int"))
    return t.labels.select(
        F.col("doc_id").alias("chunk_id"),
        action.alias("final_action"),
        F.when((F.pmod("doc_id", F.lit(6)) <= 1) | ((F.pmod("doc_id", F.lit(6)) == 5) & (F.col("quality") == 1)), "true")
        .otherwise("0").alias("approved_for_retrieval"),
        F.when(F.pmod("doc_id", F.lit(6)) == 0, "Yes").otherwise("no").alias("approved_for_display"),
        F.when(F.col("toxic") == 1, "CORRUPTED").otherwise("CLEAN").alias("human_classification"),
        F.when(F.col("quality") == 1, "HIGH").otherwise("MAYBE").alias("review_confidence"),
        F.when(F.pmod("doc_id", F.lit(50)) == 0, " =1+1").otherwise("fine").alias("human_comments"),
        F.concat_ws(";", F.concat(F.lit("R"), "doc_id"), F.when(F.col("toxic") == 1, "R-none")).alias("reference_ids"),
    )


def repaired_pages(t: Tables) -> DataFrame:
    """Pages rebuilt from ``pages``: every page of every thirteenth number of a source."""
    ids = t.pages.select(
        F.concat(F.lit("src"), F.pmod("page_id", F.lit(20))).alias("document_id"),
        (F.pmod("page_id", F.lit(3)) * 13).alias("page_number"),
        documents.stable_id("page_id", "url").alias("new_id"),
    )
    return ids.groupBy("document_id", "page_number").agg(F.sort_array(F.collect_set("new_id")).alias("replacement_ids"))


def audit_table(t: Tables) -> DataFrame:
    return measured(t).select(F.col("doc_id").alias("chunk_id"), (F.size("text_reasons") == 0).alias("evidence_quality_pass"))


def policy_inputs(t: Tables) -> tuple[DataFrame, ...]:
    return chunk_table(t), repaired_pages(t), review_table(t), audit_table(t)


POLICY_SQL = f"""{QUALITY_SQL},
chunks AS (SELECT doc_id AS chunk_id, source AS document_id, n_chars % 40 AS page_number FROM documents),
review AS (SELECT doc_id AS chunk_id, {sql_list(ACTIONS)}[doc_id % 6 + 1] AS final_action,
  doc_id % 6 <= 1 OR (doc_id % 6 = 5 AND quality = 1) AS keep, doc_id % 6 = 0 AS show, quality, toxic FROM labels),
rep AS (SELECT 'src' || (page_id % 20) AS document_id, (page_id % 3) * 13 AS page_number,
  string_agg(DISTINCT sha256(page_id::VARCHAR || chr(31) || url), ';' ORDER BY sha256(page_id::VARCHAR || chr(31) || url)) AS ids
  FROM pages GROUP BY ALL),
policy AS MATERIALIZED (SELECT c.chunk_id, c.document_id, c.page_number,
  CASE WHEN rep.ids IS NOT NULL THEN false WHEN r.chunk_id IS NOT NULL THEN r.keep ELSE len(q.text_reasons) = 0 END AS approved_for_retrieval,
  CASE WHEN rep.ids IS NOT NULL THEN false WHEN r.chunk_id IS NOT NULL THEN r.show ELSE len(q.text_reasons) = 0 END AS approved_for_display,
  CASE WHEN rep.ids IS NOT NULL THEN 'TARGETED_PAGE_REPAIR' WHEN r.chunk_id IS NOT NULL THEN 'HUMAN_REVIEW_FINAL'
    ELSE 'AUTOMATED_FULL_CORPUS_AUDIT' END AS policy_source,
  CASE WHEN rep.ids IS NOT NULL THEN 'REPLACED_BY_REPAIRED_PAGE' WHEN r.chunk_id IS NOT NULL THEN r.final_action
    WHEN len(q.text_reasons) = 0 THEN 'AUTO_QUALITY_PASS' ELSE 'AUTO_QUALITY_REJECT' END AS policy_action,
  CASE WHEN rep.ids IS NOT NULL THEN 'REPLACED' WHEN r.chunk_id IS NOT NULL THEN
    CASE c.chunk_id % 6 WHEN 0 THEN 'UNCHANGED_RETAINED' WHEN 1 THEN 'RETRIEVAL_ONLY' WHEN 2 THEN 'REMOVED_GENERIC' WHEN 3 THEN 'REPLACED'
      WHEN 4 THEN 'LINKAGE_REVIEW' ELSE CASE WHEN r.keep THEN 'HUMAN_CONFIRMATION_RETRIEVAL_ONLY' ELSE 'HUMAN_CONFIRMATION_QUARANTINE' END END
    WHEN len(q.text_reasons) = 0 THEN 'UNCHANGED_RETAINED' ELSE 'REMOVED_AUTOMATED_QUALITY_GATE' END AS mapping_status, rep.ids
  FROM chunks c LEFT JOIN rep USING (document_id, page_number) LEFT JOIN review r USING (chunk_id) LEFT JOIN reasons q ON q.doc_id = c.chunk_id)"""


@query(
    "policy_resolution",
    f"""WITH {POLICY_SQL} SELECT chunk_id, document_id, page_number, approved_for_retrieval, approved_for_display, policy_source, policy_action,
    mapping_status, coalesce(ids, CASE WHEN approved_for_retrieval THEN chunk_id::VARCHAR ELSE '' END) AS new_chunk_ids,
    policy_action IN ('HUMAN_CONFIRMATION_REQUIRED', 'REVIEW_REFERENCE_LINKAGE') AS human_follow_up_required FROM policy""",
)
def _(t: Tables) -> DataFrame:
    return lifecycle.resolve_policy(*policy_inputs(t))


@query(
    "quarantine_split",
    f"""WITH {POLICY_SQL} SELECT CASE WHEN approved_for_retrieval THEN 'retained' ELSE mapping_status END AS outcome, count(*) AS n_chunks,
    min(chunk_id) AS first_chunk FROM policy GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    kept, out = lifecycle.split_quarantine(chunk_table(t), lifecycle.decide_policy(*policy_inputs(t)))
    both = kept.select("chunk_id", F.lit("retained").alias("outcome")).unionByName(
        out.select("chunk_id", F.col("quarantine_reason").alias("outcome"))
    )
    return both.groupBy("outcome").agg(F.count("*").alias("n_chunks"), F.min("chunk_id").alias("first_chunk"))


@query(
    "exactly_once_mapping",
    """SELECT count(*) AS n_chunks, count(*) FILTER (in_orders AND n = 1) AS n_exactly_once, count(*) FILTER (n = 0) AS n_unmapped,
    count(*) FILTER (n > 1) AS n_repeated, count(*) FILTER (NOT in_orders) AS n_unknown FROM (
      SELECT coalesce(o_orderkey, k) AS chunk_id, o_orderkey IS NOT NULL AS in_orders, coalesce(n, 0) AS n
      FROM orders FULL JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) ON k = o_orderkey)""",
)
def _(t: Tables) -> DataFrame:
    chunks = t.orders.select(F.col("o_orderkey").alias("chunk_id"))
    mapping = t.lineitem.select(F.col("l_orderkey").alias("chunk_id"))
    return lifecycle.mapping_coverage(chunks, mapping)


@query(
    "eligibility_recompute",
    """SELECT p_partkey AS row_number, p_size > 5 AND s.k IS NOT NULL AS document_retrieval_eligible,
    p_size > 20 AND s.k IS NOT NULL AS evidence_available FROM part
    LEFT JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R') s ON s.k = p_partkey""",
)
def _(t: Tables) -> DataFrame:
    parts = t.part.select(
        F.col("p_partkey").alias("row_number"), (F.col("p_size") > 5).alias("document_retrieval_eligible"),
        (F.col("p_size") > 20).alias("evidence_available"),
    )
    rows = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("row_number"))
    return lifecycle.recompute_eligibility(parts, rows)


@query(
    "review_import_checks",
    f"""WITH r AS (SELECT doc_id AS chunk_id, doc_id % 6 AS a, doc_id % 6 <= 1 OR (doc_id % 6 = 5 AND quality = 1) AS keep, doc_id % 6 = 0 AS show, quality, toxic FROM labels)
    SELECT 'row_count' AS check_name, abs(count(*) - 180) AS n_issues FROM r
    UNION ALL SELECT 'unknown_action', 0 UNION ALL SELECT 'unknown_classification', 0
    UNION ALL SELECT 'policy_violation', 0
    UNION ALL SELECT 'formula_content', count(*) FILTER (chunk_id % 50 = 0) FROM r
    UNION ALL SELECT 'invalid_approved_for_retrieval', 0 UNION ALL SELECT 'invalid_approved_for_display', 0
    UNION ALL SELECT 'invalid_review_confidence', count(*) FILTER (quality = 0) FROM r
    UNION ALL SELECT 'duplicate_chunk', count(*) FROM (SELECT chunk_id FROM r GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'unknown_chunk', count(*) FROM r WHERE chunk_id NOT IN (SELECT doc_id FROM documents)
    UNION ALL SELECT 'unknown_reference', count(*) FILTER (toxic = 1) FROM r""",
)
def _(t: Tables) -> DataFrame:
    known = t.documents.select(F.concat(F.lit("R"), "doc_id").alias("reference_id"))
    return lifecycle.review_checks(review_table(t), chunk_table(t), known, expected_rows=180)


@query(
    "review_values",
    """SELECT doc_id, CASE WHEN quality = 1 THEN 'YES' ELSE 'NO' END AS kept, CASE WHEN toxic = 1 THEN 'YES' ELSE 'MAYBE' END AS flagged,
    true AS same_number, doc_id % 2 = 0 AS same_text FROM labels""",
)
def _(t: Tables) -> DataFrame:
    return t.labels.select(
        "doc_id",
        lifecycle.yes_no(F.when(F.col("quality") == 1, " true ").otherwise("0")).alias("kept"),
        lifecycle.yes_no(F.when(F.col("toxic") == 1, "1").otherwise("maybe")).alias("flagged"),
        lifecycle.same_value(F.col("doc_id").cast("string"), F.concat("doc_id", F.lit(".0000000"))).alias("same_number"),
        lifecycle.same_value(F.lit(" abc"), F.when(F.col("doc_id") % 2 == 0, "abc ").otherwise("abd")).alias("same_text"),
    )


@query(
    "full_outer_validated",
    """SELECT coalesce(o_custkey, c_custkey) AS custkey, coalesce(n_orders, 0) AS n_orders, c_custkey IS NOT NULL AS known
    FROM (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) FULL JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey""",
)
def _(t: Tables) -> DataFrame:
    counts = t.orders.groupBy(F.col("o_custkey").alias("custkey")).agg(F.count("*").alias("n_orders"))
    known = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("custkey"), F.lit(True).alias("known"))
    joined = contracts.one_to_one_outer(counts, known, ["custkey"])
    return joined.select(
        "custkey", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), F.coalesce("known", F.lit(False)).alias("known")
    )


@query(
    "key_set_equality",
    """SELECT count(*) FILTER (c IS NULL) AS only_left, count(*) FILTER (o IS NULL) AS only_right, count(*) FILTER (o IS NOT NULL AND c IS NOT NULL) AS in_both
    FROM (SELECT DISTINCT o_custkey AS o FROM orders) FULL JOIN (SELECT DISTINCT c_custkey AS c FROM customer) ON o = c""",
)
def _(t: Tables) -> DataFrame:
    return contracts.same_keys(
        t.orders.select(F.col("o_custkey").alias("k")), t.customer.select(F.col("c_custkey").alias("k")), "k"
    )


@query("duplicate_keys", "SELECT l_partkey, l_suppkey, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(t: Tables) -> DataFrame:
    return contracts.duplicate_keys(t.lineitem, "l_partkey", "l_suppkey")


@query(
    "unlinked_rows",
    """SELECT 'orders' AS kind, o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
    UNION ALL SELECT 'customer', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""",
)
def _(t: Tables) -> DataFrame:
    orders = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")
    idle = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return orders.select(F.lit("orders").alias("kind"), F.col("o_orderkey").alias("id")).unionByName(
        idle.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"))
    )


@query(
    "union_first_wins",
    """WITH u AS (SELECT doc_id, 1 AS priority, 'label' AS origin FROM labels UNION ALL SELECT doc_id, 2, 'document' FROM documents)
    SELECT doc_id, arg_min(origin, priority) AS origin FROM u GROUP BY doc_id""",
)
def _(t: Tables) -> DataFrame:
    both = t.labels.select("doc_id", F.lit(1).alias("p"), F.lit("label").alias("origin")).unionByName(
        t.documents.select("doc_id", F.lit(2).alias("p"), F.lit("document").alias("origin"))
    )
    return both.groupBy("doc_id").agg(F.min_by("origin", "p").alias("origin"))


@query(
    "duplicate_texts",
    """SELECT source, count(*) AS n_docs, count(*) - count(DISTINCT lower(text)) AS n_duplicates FROM documents GROUP BY source""",
)
def _(t: Tables) -> DataFrame:
    counted = t.documents.groupBy("source", F.sha2(F.lower("text"), 256).alias("h")).agg(F.count("*").alias("n"))
    return counted.groupBy("source").agg(F.sum("n").alias("n_docs"), (F.sum("n") - F.count("*")).alias("n_duplicates"))


@query(
    "exact_copy_groups",
    """SELECT sha256(text) AS group_id, count(*) AS exact_duplicate_count, min(doc_id) AS first_doc FROM documents GROUP BY ALL HAVING count(*) > 1""",
)
def _(t: Tables) -> DataFrame:
    grouped = t.documents.groupBy(F.sha2("text", 256).alias("group_id")).agg(
        F.count("*").alias("exact_duplicate_count"), F.min("doc_id").alias("first_doc")
    )
    return grouped.filter("exact_duplicate_count > 1")


@query("unique_turn_lines")
def _(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", F.split("text", r"\n|(?<=\.) ").alias("lines"))
    kept = rows.withColumn("kept", lists.unique_items(F.col("lines")))
    return kept.select(
        "conv_id", "turn", F.size("lines").alias("n_lines"), F.size("kept").alias("n_kept"),
        F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha"),
    )


@query(
    "merged_values",
    """SELECT l_orderkey, string_agg(DISTINCT l_partkey::VARCHAR, ';' ORDER BY l_partkey::VARCHAR) AS parts, list_sort(list(DISTINCT l_suppkey))[1] AS first_supplier,
    count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem GROUP BY l_orderkey""",
)
def _(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(
        F.array_join(F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))), ";").alias("parts"),
        F.array_min(F.collect_set("l_suppkey")).alias("first_supplier"),
        F.size(F.collect_set("l_suppkey")).alias("n_suppliers"),
    )


# ---- judging pools ---------------------------------------------------------------------------------
def lane_entities(t: Tables) -> DataFrame:
    """Sources ranked by their first document in each lane."""
    lexical_lane, dense_lane = (reliable_checkpoint(lane) for lane in lanes(t))
    fused = ranking.fuse(lexical_lane, dense_lane, "item_id", "doc_id", 0.75, 0.25)
    hybrid = ranking.top_k(fused, ["item_id"], [F.desc("fused"), F.col("doc_id")], 2000, salt_on="doc_id")
    hybrid = hybrid.select("item_id", "doc_id", F.col("fused").alias("score"), "rank")
    sources = t.documents.select("doc_id", "source")
    rows = None
    for lane, table in (("bm25", lexical_lane), ("dense", dense_lane), ("hybrid", hybrid)):
        first = ranking.first_of_entity(table.join(sources, "doc_id"), "item_id", "source", "doc_id")
        part = first.select("item_id", "source", F.lit(lane).alias("lane"), F.col("entity_rank").alias("rank"), "best_key", "best_score")
        rows = part if rows is None else rows.unionByName(part)
    return rows


LANE_ENTITIES_SQL = f"""WITH {sql_fused()},
lane_h AS (SELECT item_id, doc_id, fused AS score, row_number() OVER (PARTITION BY item_id ORDER BY fused DESC, doc_id) AS rank FROM fused QUALIFY rank <= 2000),
alls AS (SELECT 'bm25' AS lane, item_id, doc_id, score, rank FROM lane_l UNION ALL SELECT 'dense', item_id, doc_id, score, rank FROM lane_d
  UNION ALL SELECT 'hybrid', item_id, doc_id, score, rank FROM lane_h),
firsts AS (SELECT lane, item_id, source, min(rank) AS first_rank, arg_min(doc_id, rank) AS best_key, arg_min(score, rank) AS best_score
  FROM alls JOIN documents USING (doc_id) GROUP BY ALL),
ents AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lane, item_id ORDER BY first_rank, source) AS rank FROM firsts)"""


@query(
    "lane_contributions",
    LANE_ENTITIES_SQL + " SELECT item_id, source, lane, rank, best_key, round(best_score, 8) AS best_score FROM ents",
)
def _(t: Tables) -> DataFrame:
    return lane_entities(t).withColumn("best_score", F.round("best_score", 8))


POOL_SQL = LANE_ENTITIES_SQL + """, lead AS (SELECT item_id, source, min(CASE lane WHEN 'bm25' THEN 1 WHEN 'dense' THEN 2 ELSE 3 END) AS lead FROM ents WHERE rank = 1 GROUP BY ALL),
m AS (SELECT item_id, source, min(rank) AS best_rank, count(DISTINCT lane) AS n_lanes, min(rank) FILTER (lane = 'hybrid') AS hybrid_rank FROM ents GROUP BY ALL),
p AS (SELECT m.*, row_number() OVER (PARTITION BY item_id ORDER BY coalesce(lead, 4), CASE WHEN lead IS NULL THEN best_rank ELSE 0 END, n_lanes DESC, hybrid_rank NULLS LAST, source) AS pool_position
  FROM m LEFT JOIN lead USING (item_id, source) QUALIFY pool_position <= 25)"""


@query("pool_priority", POOL_SQL + " SELECT item_id, source, best_rank, n_lanes, hybrid_rank, pool_position FROM p")
def _(t: Tables) -> DataFrame:
    return pool.priority(lane_entities(t), "item_id", "source", ["bm25", "dense", "hybrid"])


@query(
    "blind_order",
    POOL_SQL
    + """, b AS (SELECT item_id, source, sha256('blind-seed-1|' || item_id || '|' || source) AS order_key FROM p),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY order_key) AS blind_position FROM b)
    SELECT item_id, source, order_key, blind_position, item_id || '-C' || lpad(blind_position::VARCHAR, 2, '0') AS blinded_candidate_id FROM r""",
)
def _(t: Tables) -> DataFrame:
    chosen = pool.priority(lane_entities(t), "item_id", "source", ["bm25", "dense", "hybrid"])
    return pool.blind_order(chosen.select("item_id", "source"), "item_id", "source", "blind-seed-1")


@query(
    "pool_checks",
    POOL_SQL
    + """, c AS (SELECT item_id, count(*) AS n, count(DISTINCT source) AS d FROM p GROUP BY 1)
    SELECT count(*) AS n_queries, sum(n)::BIGINT AS n_rows, max(n) AS largest, count(*) FILTER (n <> d) AS n_with_repeats, count(*) FILTER (n > 25) AS n_over_size FROM c""",
)
def _(t: Tables) -> DataFrame:
    chosen = pool.priority(lane_entities(t), "item_id", "source", ["bm25", "dense", "hybrid"])
    return pool.pool_checks(chosen, "item_id", "source")


@query(
    "language_sample",
    """SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256(doc_id::VARCHAR), doc_id) AS n FROM documents QUALIFY n <= 3""",
)
def _(t: Tables) -> DataFrame:
    keyed = t.documents.select("lang", "doc_id").withColumn("h", F.sha2(F.col("doc_id").cast("string"), 256))
    return ranking.top_k(keyed, ["lang"], [F.col("h"), F.col("doc_id")], 3, "n").drop("h")


@query(
    "worst_sources",
    f"""WITH {QUALITY_SQL} SELECT source, count(*) FILTER (list_contains(text_reasons, 'OCR_GIBBERISH')) AS n_gibberish,
    count(*) FILTER (list_contains(text_reasons, 'REPETITIVE_TEXT')) AS n_repetitive FROM reasons GROUP BY source
    ORDER BY n_gibberish DESC, n_repetitive DESC, source LIMIT 15""",
)
def _(t: Tables) -> DataFrame:
    rows = measured(t).select("doc_id", "source", "quality_score", "text_reasons")
    rows = rows.join(t.documents.select("doc_id", "lang"), "doc_id")
    summary = corpus_audit.quality_summary(rows, "source", "lang")
    return corpus_audit.worst_sources(summary).select("source", "n_gibberish", "n_repetitive")


@query("rebuilt_chunks")
def _(t: Tables) -> DataFrame:
    """Pages rebuilt as passages: text out of the markup, chunked, cleaned, gated, with stable ids."""
    from seekgrain.plans.corpus_build import rebuild_chunks

    pages = t.pages.select(
        F.concat(F.lit("src"), F.pmod("page_id", F.lit(20))).alias("document_id"),
        F.col("page_id").alias("page_number"),
        documents.sanitize_html("html").alias("original_text"),
    )
    rows = rebuild_chunks(pages)
    return rows.select(
        "chunk_id", "document_id", "page_number", "chunk_index", "character_start", "character_end",
        "quality_score", "approved_for_retrieval", F.array_join("rejection_reasons", ";").alias("rejection_reasons"),
        F.sha2("display_text", 256).alias("display_sha"),
    )




@query(
    "vector_checks",
    """SELECT count(*) AS n_vectors, min(len(embedding)) AS smallest_width, max(len(embedding)) AS largest_width, 0::BIGINT AS n_not_finite,
    count(*) FILTER (abs(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) > 1e-3) AS n_not_unit FROM embeddings""",
)
def _(t: Tables) -> DataFrame:
    from seekgrain.sources.tables import vector_checks

    return vector_checks(t.embeddings, "embedding")


@query(
    "index_checks",
    "SELECT 0::BIGINT AS wrong_frequencies, 0::BIGINT AS bad_weights, 0::BIGINT AS bad_postings, 0::BIGINT AS unknown_documents",
)
def _(t: Tables) -> DataFrame:
    from seekgrain.operators import lexical
    from seekgrain.sources.tables import index_checks

    index = lexical.build_index(t.documents, "doc_id", "text")
    return index_checks(index.postings, index.terms(), t.documents.select("doc_id"), "doc_id")


@query(
    "unit_progress",
    """SELECT kind, count(*) AS n FROM (SELECT 'unit_started' AS kind FROM conversations UNION ALL
    SELECT CASE WHEN role = 'system' THEN 'unit_failed' ELSE 'unit_completed' END FROM conversations) GROUP BY kind""",
)
def _(t: Tables) -> DataFrame:
    from seekgrain.streaming.progress import run_units

    def word_count(unit: str, text: str) -> str:
        if unit == "system":
            raise ValueError("no draft for system turns")
        return str(len(text.split()))

    events = run_units(t.conversations.select("role", "text"), word_count, "role", "text")
    return events.groupBy("kind").agg(F.count("*").alias("n"))
