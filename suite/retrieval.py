"""Lexical, dense and hybrid retrieval over ``documents``, ``benchmark`` and ``embeddings``.

Queries are the ``benchmark`` texts; the stored vector with the same id stands for the encoded
query. Vectors belong to the document with the same id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekgrain.operators import dense, gates, lexical, metrics, ranking
from seekgrain.presets import SELECTED, WEIGHT_PAIRS, TermSettings
from seekgrain.session import reliable_checkpoint
from suite.base import SQL_STOPWORDS, Tables, query, sql_fold, sql_tokens, sql_words

# ---- shared stages -----------------------------------------------------------------------------


def benchmark_terms(t: Tables):
    tokens = lexical.query_tokens(t.benchmark, "item_id", "text")
    index = lexical.build_index(t.documents, "doc_id", "text", tokens)
    return index, lexical.analyze_terms(tokens, index.terms(), "item_id", TermSettings())


def lexical_scores(t: Tables) -> DataFrame:
    index, terms = benchmark_terms(t)
    kept = terms.filter("status = 'meaningful'").select("item_id", "term")
    return lexical.score(index, kept, "item_id")


def query_vectors(t: Tables) -> DataFrame:
    stored = t.embeddings.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("query_vector"))
    return t.benchmark.select("item_id").join(stored, "item_id")


def passages(t: Tables) -> DataFrame:
    vectors = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    return t.documents.select("doc_id", "lang").join(vectors, "doc_id")


def lanes(t: Tables, depth: int = SELECTED.depth):
    hits = lexical_scores(t)
    filled = ranking.zero_filled(hits, t.benchmark, t.documents, depth, "item_id", "doc_id")
    order = [F.desc("score"), F.col("doc_id")]
    lexical_lane = ranking.top_k(filled, ["item_id"], order, depth, salt_on="doc_id")
    dense_lane = dense.score_many(
        passages(t), query_vectors(t), depth, "doc_id", "embedding", "item_id", "query_vector"
    )
    return lexical_lane, dense_lane


def fused_table(t: Tables, weights=(SELECTED.lexical_weight, SELECTED.dense_weight)) -> DataFrame:
    lexical_lane, dense_lane = lanes(t)
    return ranking.fuse(lexical_lane, dense_lane, "item_id", "doc_id", *weights)


# ---- SQL of the same stages --------------------------------------------------------------------
DOC_TOKENS = f"""
dt AS MATERIALIZED (SELECT doc_id, {sql_tokens('text')} AS toks FROM documents),
totals AS (SELECT count(*) AS n_docs, avg(len(toks)) AS avg_len FROM dt),
post AS MATERIALIZED (
  SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl
  FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM dt) GROUP BY doc_id, term),
terms AS MATERIALIZED (
  SELECT term, count(*) AS df, ln(1 + (n_docs - count(*) + 0.5) / (count(*) + 0.5)) AS idf,
         count(*) / n_docs AS df_ratio
  FROM post, totals GROUP BY term, n_docs)"""
QUERY_TERMS = f"""
qraw AS (
  SELECT item_id, unnest(ws) AS raw, generate_subscripts(ws, 1) - 1 AS position
  FROM (SELECT item_id, {sql_words('text')} AS ws FROM benchmark)),
qtok AS (
  SELECT item_id, {sql_fold('raw')} AS term, min(position) AS position, arg_min(raw, position) AS raw
  FROM qraw WHERE length({sql_fold('raw')}) >= 2 GROUP BY ALL),
qstat AS MATERIALIZED (
  SELECT q.item_id, q.position, q.term, q.raw, t.df, t.idf, t.df_ratio,
    CASE WHEN list_contains({SQL_STOPWORDS}, q.term) THEN 'stopword'
         WHEN t.df IS NULL THEN 'unknown'
         WHEN t.idf < 0.5 OR t.df_ratio > 0.62 THEN 'common' ELSE 'meaningful' END AS status
  FROM (SELECT item_id, term, min(position) AS position, arg_min(raw, position) AS raw FROM qtok GROUP BY ALL) q
  LEFT JOIN terms t USING (term))"""
LEXICAL = f"""{DOC_TOKENS}, {QUERY_TERMS},
lex AS MATERIALIZED (
  SELECT q.item_id, p.doc_id,
    round(sum(q.idf * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.dl / avg_len))), 6) AS score
  FROM qstat q JOIN post p USING (term), totals WHERE q.status = 'meaningful' GROUP BY ALL)"""
LANES = f"""{LEXICAL},
lane_l AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
  FROM (SELECT b.item_id, d.doc_id, coalesce(l.score, 0.0) AS score
        FROM benchmark b CROSS JOIN documents d LEFT JOIN lex l USING (item_id, doc_id))
  QUALIFY rank <= 2000),
dens AS (
  SELECT b.item_id, d.doc_id,
    round(list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
  FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, documents d JOIN embeddings e ON e.vec_id = d.doc_id),
lane_d AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
  FROM dens QUALIFY rank <= 2000)"""


def sql_fused(lexical_weight: str = "0.75", dense_weight: str = "0.25") -> str:
    return f"""{LANES},
fused AS MATERIALIZED (
  SELECT item_id, doc_id, round(sum(part), 10) AS fused, max(lr) AS lexical_rank, max(dr) AS dense_rank,
    max(ls) AS lexical_score, max(ds) AS dense_score
  FROM (SELECT item_id, doc_id, {lexical_weight} / (60 + rank) AS part, rank AS lr, NULL AS dr, score AS ls, NULL AS ds
          FROM lane_l
        UNION ALL
        SELECT item_id, doc_id, {dense_weight} / (60 + rank), NULL, rank, NULL, score FROM lane_d)
  GROUP BY item_id, doc_id)"""


# ---- queries -----------------------------------------------------------------------------------
@query(
    "token_document_frequency",
    f"WITH {DOC_TOKENS} SELECT term, df, round(idf, 6) AS idf, round(df_ratio, 6) AS df_ratio FROM terms",
)
def _(t: Tables) -> DataFrame:
    terms = lexical.build_index(t.documents, "doc_id", "text").terms()
    return terms.select("term", "df", F.round("idf", 6).alias("idf"), F.round("df_ratio", 6).alias("df_ratio"))


@query(
    "document_lengths",
    f"""WITH {DOC_TOKENS} SELECT lang, count(*) AS n_docs, round(avg(len(toks)), 6) AS average_length,
    max(len(toks)) AS longest FROM dt JOIN documents USING (doc_id) GROUP BY lang""",
)
def _(t: Tables) -> DataFrame:
    tokens = lexical.token_table(t.documents.select("doc_id", "text"), "doc_id", "text").drop("tokens")
    return (
        tokens.join(t.documents.select("doc_id", "lang"), "doc_id")
        .groupBy("lang")
        .agg(
            F.count("*").alias("n_docs"),
            F.round(F.avg("doc_length"), 6).alias("average_length"),
            F.max("doc_length").alias("longest"),
        )
    )


@query(
    "query_term_analysis",
    f"""WITH {DOC_TOKENS}, {QUERY_TERMS}
    SELECT item_id, position, term, raw AS display, status, 'term' AS category,
      round(idf, 6) AS idf, df, round(df_ratio, 6) AS df_ratio FROM qstat""",
)
def _(t: Tables) -> DataFrame:
    terms = benchmark_terms(t)[1]
    return terms.select(
        "item_id", "position", "term", "display", "status", "category",
        F.round("idf", 6).alias("idf"), "df", F.round("df_ratio", 6).alias("df_ratio"),
    )


@query(
    "bm25_topk",
    f"""WITH {LEXICAL} SELECT item_id, doc_id, score,
    row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM lex QUALIFY rank <= 20""",
)
def _(t: Tables) -> DataFrame:
    return ranking.top_k(lexical_scores(t), ["item_id"], [F.desc("score"), F.col("doc_id")], 20)


@query(
    "dense_topk",
    f"""WITH {LANES} SELECT item_id, doc_id, score, rank FROM lane_d WHERE rank <= 20""",
)
def _(t: Tables) -> DataFrame:
    return dense.score_many(passages(t), query_vectors(t), 20, "doc_id", "embedding", "item_id", "query_vector")


@query(
    "dense_centroid_topk",
    """WITH parts AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    cent AS (SELECT label, list(m ORDER BY i) AS c FROM
      (SELECT label, i, round(avg(x::DOUBLE), 6) AS m FROM parts GROUP BY label, i) GROUP BY label),
    s AS (SELECT c.label AS centroid, e.vec_id,
      round(list_inner_product(e.embedding::DOUBLE[], c.c), 6) AS score FROM cent c, embeddings e)
    SELECT centroid, vec_id, score,
      row_number() OVER (PARTITION BY centroid ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 25""",
)
def _(t: Tables) -> DataFrame:
    parts = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("m"))
    centroids = means.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("center")
    )
    return dense.score_many(
        t.embeddings, centroids.withColumnRenamed("label", "centroid"), 25, "vec_id", "embedding", "centroid", "center"
    )


@query(
    "rrf_hybrid",
    f"""WITH {sql_fused()} SELECT item_id, doc_id, fused, lexical_rank, dense_rank,
    row_number() OVER (PARTITION BY item_id ORDER BY fused DESC, doc_id) AS rank FROM fused QUALIFY rank <= 50""",
)
def _(t: Tables) -> DataFrame:
    fused = fused_table(t).select("item_id", "doc_id", "fused", "lexical_rank", "dense_rank")
    return ranking.top_k(fused, ["item_id"], [F.desc("fused"), F.col("doc_id")], 50)


@query(
    "lane_overlap",
    f"""WITH {LANES} SELECT l.item_id, count(d.doc_id) AS top_agreement
    FROM lane_l l LEFT JOIN lane_d d ON l.item_id = d.item_id AND l.doc_id = d.doc_id AND d.rank <= 10
    WHERE l.rank <= 10 GROUP BY l.item_id""",
)
def _(t: Tables) -> DataFrame:
    return ranking.lane_overlap(fused_table(t), "item_id", 10)


def _sweep_sql() -> str:
    pairs = ", ".join(f"({a}, {b})" for a, b in WEIGHT_PAIRS)
    return f"""WITH {LANES}, w(lexical_weight, dense_weight) AS (VALUES {pairs}),
    f AS (SELECT lexical_weight, dense_weight, item_id, doc_id, round(sum(part), 10) AS fused FROM (
      SELECT lexical_weight, dense_weight, item_id, doc_id, lexical_weight / (60 + rank) AS part FROM lane_l, w
      UNION ALL SELECT lexical_weight, dense_weight, item_id, doc_id, dense_weight / (60 + rank) FROM lane_d, w)
      GROUP BY ALL)
    SELECT lexical_weight::DOUBLE AS lexical_weight, dense_weight::DOUBLE AS dense_weight, item_id, doc_id, fused,
      row_number() OVER (PARTITION BY lexical_weight, item_id ORDER BY fused DESC, doc_id) AS rank
    FROM f QUALIFY rank <= 10"""


@query("weight_sweep", _sweep_sql())
def _(t: Tables) -> DataFrame:
    """Rank once per lane, fuse once per weight pair."""
    lexical_lane, dense_lane = lanes(t)
    pairs = F.array(*[F.struct(F.lit(a).alias("lw"), F.lit(b).alias("dw")) for a, b in WEIGHT_PAIRS])
    ranks = lexical_lane.select("item_id", "doc_id", F.col("rank").alias("lr"), F.lit(None).cast("int").alias("dr"))
    ranks = ranks.unionByName(
        dense_lane.select("item_id", "doc_id", F.lit(None).cast("int").alias("lr"), F.col("rank").alias("dr"))
    )
    ranks = ranks.groupBy("item_id", "doc_id").agg(F.max("lr").alias("lr"), F.max("dr").alias("dr"))
    part = lambda w, r: F.coalesce(F.col(w) / (60 + F.col(r)), F.lit(0.0))
    fused = ranks.select("*", F.explode(pairs).alias("w")).select(
        F.col("w.lw").alias("lexical_weight"), F.col("w.dw").alias("dense_weight"), "item_id", "doc_id",
        F.round(part("w.lw", "lr") + part("w.dw", "dr"), 10).alias("fused"),
    )
    return ranking.top_k(
        fused, ["lexical_weight", "dense_weight", "item_id"], [F.desc("fused"), F.col("doc_id")], 10
    )


JUDGED = """judged AS (SELECT b.item_id, l.doc_id, l.quality + (1 - l.toxic) AS relevance
  FROM labels l JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = l.doc_id % (SELECT count(*) FROM benchmark))"""


def judgments(t: Tables) -> DataFrame:
    """Graded stand-ins: each labelled document is judged for one benchmark item."""
    n = F.lit(t.benchmark.agg(F.count("*").alias("n")).scalar())
    return t.labels.join(t.documents.select("doc_id"), "doc_id", "left_semi").select(
        F.pmod("doc_id", n).alias("item_id"), "doc_id", (F.col("quality") + 1 - F.col("toxic")).alias("relevance")
    )


METRICS_SQL = f"""WITH {LEXICAL}, {JUDGED},
ranked AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
  FROM lex QUALIFY rank <= 20),
hit AS (SELECT r.item_id, r.doc_id, r.rank, coalesce(j.relevance, 0) AS g
  FROM ranked r LEFT JOIN judged j USING (item_id, doc_id)),
lists AS (SELECT item_id, count(*) FILTER (g > 0) AS hits, min(rank) FILTER (g > 0) AS first_hit,
  sum((pow(2, g) - 1) / log2(rank + 1)) AS dcg FROM hit GROUP BY item_id),
ideal AS (SELECT item_id, sum((pow(2, relevance) - 1) / log2(r + 1)) AS idcg FROM
  (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY relevance DESC, doc_id) AS r FROM judged QUALIFY r <= 20)
  GROUP BY item_id),
tot AS (SELECT item_id, count(*) FILTER (relevance > 0) AS n_rel FROM judged GROUP BY item_id),
m AS (SELECT item_id, CASE WHEN coalesce(hits, 0) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS success_at_20,
  round(coalesce(hits, 0) / 20, 6) AS precision_at_20,
  round(CASE WHEN n_rel > 0 THEN coalesce(hits, 0) / n_rel ELSE 0 END, 6) AS recall_at_20,
  round(coalesce(1 / first_hit, 0), 6) AS mrr_at_20,
  round(CASE WHEN idcg > 0 THEN coalesce(dcg, 0) / idcg ELSE 0 END, 6) AS ndcg_at_20
  FROM tot LEFT JOIN lists USING (item_id) LEFT JOIN ideal USING (item_id))"""


def _metrics(t: Tables) -> DataFrame:
    ranked = ranking.top_k(lexical_scores(t), ["item_id"], [F.desc("score"), F.col("doc_id")], 20)
    return metrics.per_query(ranked, judgments(t), "item_id", "doc_id", 20)


@query("ir_metrics_per_query", METRICS_SQL + " SELECT * FROM m")
def _(t: Tables) -> DataFrame:
    return _metrics(t)


@query(
    "ir_metrics_macro",
    METRICS_SQL
    + """ SELECT round(avg(success_at_20), 6) AS success_at_20, round(avg(precision_at_20), 6) AS precision_at_20,
    round(avg(recall_at_20), 6) AS recall_at_20, round(avg(mrr_at_20), 6) AS mrr_at_20,
    round(avg(ndcg_at_20), 6) AS ndcg_at_20 FROM m""",
)
def _(t: Tables) -> DataFrame:
    return metrics.macro(_metrics(t), "item_id")


GROUPS_SQL = f"""WITH {sql_fused()},
top AS (SELECT f.*, row_number() OVER (PARTITION BY item_id ORDER BY fused DESC, doc_id) AS fr
  FROM fused f QUALIFY fr <= 2000),
g AS MATERIALIZED (SELECT top.*, d.source AS entity, coalesce(dense_score, -1.0) AS dense
  FROM top JOIN documents d USING (doc_id)),
o AS MATERIALIZED (SELECT item_id, entity, doc_id, fused, dense, lexical_score,
  row_number() OVER (PARTITION BY item_id, entity ORDER BY fused DESC, doc_id) AS r FROM g),
two AS (SELECT item_id, entity, max(doc_id) FILTER (r = 1) AS best_passage, max(doc_id) FILTER (r = 2) AS supporting_passage,
  max(fused) FILTER (r = 1) AS best, max(fused) FILTER (r = 2) AS second,
  max(lexical_score) FILTER (r = 2) AS second_coverage, max(dense) FILTER (r = 2) AS second_dense
  FROM o WHERE r <= 2 GROUP BY item_id, entity)"""


def _entity_rows(t: Tables) -> DataFrame:
    fused = ranking.top_k(
        fused_table(t), ["item_id"], [F.desc("fused"), F.col("doc_id")], SELECTED.depth, "fused_rank", salt_on="doc_id"
    )
    return fused.join(t.documents.select("doc_id", F.col("source").alias("entity")), "doc_id").withColumn(
        "dense", F.coalesce("dense_score", F.lit(-1.0))
    )


@query(
    "reference_aggregation",
    GROUPS_SQL
    + """ SELECT item_id, entity, best_passage, supporting_passage, round(best, 8) AS a_max,
    round(CASE WHEN second IS NULL THEN best ELSE (best + second) / 2 END, 8) AS b_top2_mean,
    round(best + CASE WHEN second IS NOT NULL AND (coalesce(second_coverage, 0) > 0 OR coalesce(second_dense, -1) >= 0.72)
      THEN 0.0008 ELSE 0 END, 8) AS c_best_plus_support,
    round(best + 0.0008 * least(CASE WHEN second IS NULL THEN 1 ELSE 2 END, 3), 8) AS d_field_agreement FROM two""",
)
def _(t: Tables) -> DataFrame:
    rows = _entity_rows(t).withColumns(
        {"selection_score": F.lit(0.0), "coverage": F.coalesce("lexical_score", F.lit(0.0))}
    )
    two = gates.best_two(rows, ["item_id", "entity"], "doc_id")
    fields = F.when(F.col("second").isNull(), 1).otherwise(2)
    return two.select(
        "item_id", "entity", "best_passage", "supporting_passage",
        *[F.round(gates.strategy_score(s, agreement=fields), 8).alias(s.lower()) for s in gates.STRATEGIES],
    )


@query(
    "entity_groups",
    GROUPS_SQL
    + """ , lead AS (SELECT item_id, entity, round(max(fused), 8) AS best_fused, max(coalesce(lexical_score, 0)) AS best_bm25,
      max(dense) AS best_dense, count(*) AS n_rows, bool_or(coalesce(lexical_rank <= 50 AND dense_rank <= 50, false)) AS agreed,
      arg_max(doc_id, struct_pack(a := coalesce(lexical_score, 0), b := -fr))
        = arg_max(doc_id, struct_pack(a := dense, b := -fr)) AS same FROM g GROUP BY item_id, entity),
    top5 AS (SELECT item_id, entity, round(avg(dense), 6) AS mean_top_dense FROM
      (SELECT *, row_number() OVER (PARTITION BY item_id, entity ORDER BY dense DESC, doc_id) AS r FROM g QUALIFY r <= 5)
      GROUP BY item_id, entity)
    SELECT item_id, entity, best_fused, best_bm25, best_dense, n_rows,
      CASE WHEN agreed AND same THEN 2 WHEN agreed THEN 1 ELSE 0 END AS retriever_agreement, mean_top_dense
    FROM lead JOIN top5 USING (item_id, entity)""",
)
def _(t: Tables) -> DataFrame:
    from seekgrain.operators import evidence

    rows = _entity_rows(t).withColumn("lexical", F.coalesce("lexical_score", F.lit(0.0)))
    rows = reliable_checkpoint(rows.withColumnsRenamed({"item_id": "query_id"}))
    links = rows.select("doc_id", F.col("entity").alias("reference_id")).distinct()
    bare = rows.drop("entity")
    keys = ["query_id", "reference_id"]
    groups = evidence.reference_groups(bare, links, "doc_id", SELECTED.agreement_depth)
    means = evidence.mean_of_best(bare.join(links, "doc_id"), keys, "dense", 5, "doc_id")
    return groups.join(means, keys).select(
        F.col("query_id").alias("item_id"), F.col("reference_id").alias("entity"),
        F.round("best_fused", 8).alias("best_fused"), "best_bm25", "best_dense", "n_rows",
        "retriever_agreement", F.round("mean_top_dense", 6).alias("mean_top_dense"),
    )


@query(
    "evidence_pool",
    GROUPS_SQL
    + """ SELECT item_id, entity, doc_id, fr AS fused_rank,
    row_number() OVER (PARTITION BY item_id, entity ORDER BY fr) AS pool_rank FROM g QUALIFY pool_rank <= 12""",
)
def _(t: Tables) -> DataFrame:
    rows = _entity_rows(t).select("item_id", "entity", "doc_id", "fused_rank")
    return ranking.top_k(rows, ["item_id", "entity"], [F.col("fused_rank")], SELECTED.evidence.pool, "pool_rank")
