"""Catalog operators: facets, filters, links, intervals, field scoring, sorting and paging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekgrain import presets
from seekgrain.functions import text as tx
from seekgrain.operators import catalog, fields, gates, metrics, ranking, reasons
from seekgrain.session import BROADCAST_ROWS, is_bounded
from suite.base import Tables, query, sql_fold, sql_tokens


def customers(t: Tables) -> DataFrame:
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return t.customer.join(places, F.col("c_nationkey") == F.col("n_nationkey"))


def customer_facets():
    return {
        "country": F.array("n_name"),
        "region": F.array("r_name"),
        "sector": F.array("c_mktsegment"),
        "standing": F.array(F.when(F.col("c_acctbal") < 0, "In debt").otherwise("In credit"), F.col("c_mktsegment")),
    }


FACETS_SQL = f"""base AS (SELECT c_custkey, n_name, r_name, c_mktsegment, CASE WHEN c_acctbal < 0 THEN 'In debt' ELSE 'In credit' END AS standing
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
  vals AS (SELECT c_custkey, 'country' AS category, n_name AS label FROM base UNION SELECT c_custkey, 'region', r_name FROM base
    UNION SELECT c_custkey, 'sector', c_mktsegment FROM base UNION SELECT c_custkey, 'standing', standing FROM base
    UNION SELECT c_custkey, 'standing', c_mktsegment FROM base),
  keyed AS (SELECT *, trim(regexp_replace({sql_fold('label')}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) AS facet FROM vals),
  vocab AS (SELECT category, facet, arg_min(label, c_custkey) AS value, count(*) AS n_labels FROM keyed GROUP BY ALL)"""


@query("facet_vocabulary", f"WITH {FACETS_SQL} SELECT category, facet, value, n_labels FROM vocab")
def _(t: Tables) -> DataFrame:
    return catalog.vocabulary(catalog.facet_values(customers(t), "c_custkey", customer_facets()), "c_custkey")


@query(
    "facet_counts",
    f"""WITH {FACETS_SQL} SELECT k.category, v.value, count(DISTINCT k.c_custkey) AS n_references
    FROM keyed k JOIN vocab v USING (category, facet) GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    values = catalog.facet_values(customers(t), "c_custkey", customer_facets())
    return catalog.facet_counts(values, "c_custkey", catalog.vocabulary(values, "c_custkey"))


@query(
    "facet_counts_filtered",
    f"""WITH {FACETS_SQL}, kept AS (SELECT c_custkey FROM base WHERE r_name IN ('ASIA', 'EUROPE') AND c_mktsegment = 'BUILDING')
    SELECT k.category, v.value, count(DISTINCT k.c_custkey) AS n_references
    FROM keyed k JOIN kept USING (c_custkey) JOIN vocab v USING (category, facet) GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    rows = customers(t)
    labels = catalog.vocabulary(catalog.facet_values(rows, "c_custkey", customer_facets()), "c_custkey")
    request = catalog.FilterRequest({"region": ["asia", "Europe"], "sector": ["building"]})
    kept = catalog.apply_filters(rows, request, customer_facets())
    return catalog.facet_counts(catalog.facet_values(kept, "c_custkey", customer_facets()), "c_custkey", labels)


@query(
    "hard_filter_and_or",
    """SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND c_mktsegment = 'MACHINERY'""",
)
def _(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    request = catalog.FilterRequest(
        {"status": ["f", "O"], "priority": ["1-urgent", "2 high"], "sector": [" machinery "]}
    )
    columns = {"status": F.array("o_orderstatus"), "priority": F.array("o_orderpriority"), "sector": F.array("c_mktsegment")}
    return catalog.apply_filters(rows, request, columns).select("o_orderkey", "o_orderstatus", "o_orderpriority")


def order_spans(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_orderkey").alias("order_id")).agg(
        F.min(F.year("l_shipdate")).alias("start_year"), F.max(F.year("l_shipdate")).alias("end_year")
    )


SPANS_SQL = """spans AS (SELECT l_orderkey AS order_id, min(year(l_shipdate)) AS start_year, max(year(l_shipdate)) AS end_year
  FROM lineitem GROUP BY l_orderkey)"""


@query("interval_overlap", f"WITH {SPANS_SQL} SELECT * FROM spans WHERE start_year <= 1997 AND end_year >= 1996")
def _(t: Tables) -> DataFrame:
    return order_spans(t).filter(catalog.overlaps(F.col("start_year"), F.col("end_year"), 1996, 1997))


@query(
    "year_in_interval",
    f"WITH {SPANS_SQL} SELECT * FROM spans WHERE 1995 BETWEEN start_year AND end_year OR 2001 BETWEEN start_year AND end_year",
)
def _(t: Tables) -> DataFrame:
    request = catalog.resolve_request({"project_year": ["2001", 1995]}, 2003)
    return catalog.apply_filters(order_spans(t), request, {})


@query(
    "period_preset",
    f"WITH {SPANS_SQL} SELECT * FROM spans WHERE start_year <= 2001 AND end_year >= 1999",
)
def _(t: Tables) -> DataFrame:
    request = catalog.resolve_request({"period": {"preset": "last_3_years"}}, 2001)
    return catalog.apply_filters(order_spans(t), request, {})


@query(
    "year_range",
    f"WITH {SPANS_SQL} SELECT least(min(start_year), min(end_year)) AS min_year, greatest(max(start_year), max(end_year)) AS max_year FROM spans",
)
def _(t: Tables) -> DataFrame:
    return catalog.year_range(order_spans(t))


@query(
    "period_from_text",
    f"""WITH {SPANS_SQL} SELECT order_id, start_year, CASE WHEN end_year >= 2001 THEN 2003 ELSE end_year END AS end_year,
    end_year AS source_end_year, CASE WHEN end_year >= 2001 THEN start_year || '–present'
      WHEN start_year <> end_year THEN start_year || '–' || end_year ELSE start_year::VARCHAR END AS period,
    CASE WHEN end_year >= 2001 THEN 'ongoing' ELSE 'completed' END AS status FROM spans""",
)
def _(t: Tables) -> DataFrame:
    raw = F.concat(
        F.concat_ws(", ", F.col("end_year").cast("string"), F.col("start_year").cast("string")),
        F.when(F.col("end_year") >= 2001, "  - Présent ").otherwise(" "),
    )
    texts = order_spans(t).select("order_id", raw.alias("raw"))
    return texts.select("order_id", catalog.period(F.col("raw"), 2003).alias("p")).select("order_id", "p.*")


@query(
    "country_alias",
    """SELECT c_custkey, CASE WHEN n_name = 'FRANCE' THEN 'France' ELSE n_name END AS label, CASE WHEN n_name = 'FRANCE' THEN 'FR' END AS code
    FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def _(t: Tables) -> DataFrame:
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select("c_custkey", catalog.country(F.col("n_name")).alias("c")).select("c_custkey", "c.*")


LINKS_SQL = """links AS (SELECT DISTINCT l_orderkey AS order_id, l_partkey AS row_number FROM lineitem)"""


def order_links(t: Tables) -> DataFrame:
    """Order lines folded into the JSON list a passage carries, then linked back to eligible parts."""
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("order_id")).agg(
        F.to_json(F.collect_set("l_partkey")).alias("reference_rows_json")
    )
    parts = t.part.select(
        F.col("p_partkey").cast("int").alias("row_number"),
        F.format_string("R%09d", "p_partkey").alias("reference_id"),
        (F.col("p_size") > 5).alias("document_retrieval_eligible"),
    )
    return catalog.bridge(rows, parts, "order_id")


@query(
    "bridge_explode_join",
    f"""WITH {LINKS_SQL} SELECT order_id, 'R' || lpad(row_number::VARCHAR, 9, '0') AS reference_id
    FROM links JOIN part ON p_partkey = row_number WHERE p_size > 5""",
)
def _(t: Tables) -> DataFrame:
    return order_links(t)


@query(
    "eligible_references",
    f"""WITH {LINKS_SQL} SELECT 'R' || lpad(p_partkey::VARCHAR, 9, '0') AS reference_id, count(*) AS n_linked
    FROM part JOIN links ON row_number = p_partkey WHERE p_size > 5 GROUP BY p_partkey""",
)
def _(t: Tables) -> DataFrame:
    return order_links(t).groupBy("reference_id").agg(F.count("*").alias("n_linked"))


@query(
    "projected_scores",
    f"""WITH {LINKS_SQL} SELECT order_id, max(p_retailprice) AS score FROM links JOIN part ON p_partkey = row_number
    WHERE p_size > 5 GROUP BY order_id""",
)
def _(t: Tables) -> DataFrame:
    scores = t.part.select(
        F.lit(0).alias("query_id"), F.format_string("R%09d", "p_partkey").alias("reference_id"),
        F.col("p_retailprice").alias("score"),
    )
    return fields.project_to_passages(scores, order_links(t), "query_id", "order_id").drop("query_id")


@query("normalized_catalog")
def _(t: Tables) -> DataFrame:
    from suite.corpus import corpus

    return corpus(t).references


# ---- field scoring ------------------------------------------------------------------------------
FIELD_COLUMNS = {"title": "p_name", "client": "p_brand", "offerings": "p_type"}
_WEIGHTS = "CASE field WHEN 'title' THEN 2.40 WHEN 'client' THEN 0.05 ELSE 1.00 END"
_BONUS = "CASE field WHEN 'title' THEN 1.20 WHEN 'client' THEN 0.00 ELSE 0.50 END"
FIELDS_SQL = f"""qt AS (SELECT DISTINCT p_type AS query_id, unnest({sql_tokens("p_name || ' ' || p_type")}) AS term
    FROM (SELECT p_type, arg_min(p_name, p_partkey) AS p_name FROM part GROUP BY p_type)),
  ft AS MATERIALIZED (SELECT p_partkey, field, term, count(*) AS tf FROM (
    SELECT p_partkey, 'title' AS field, unnest({sql_tokens('p_name')}) AS term FROM part
    UNION ALL SELECT p_partkey, 'client', unnest({sql_tokens('p_brand')}) FROM part
    UNION ALL SELECT p_partkey, 'offerings', unnest({sql_tokens('p_type')}) FROM part) GROUP BY ALL),
  n AS (SELECT count(DISTINCT p_partkey) AS n FROM ft),
  len AS (SELECT p_partkey, field, sum(tf) AS length FROM ft GROUP BY ALL),
  av AS (SELECT field, sum(length) / any_value(n) AS average FROM len, n GROUP BY field),
  df AS (SELECT field, term, count(*) AS df FROM ft GROUP BY ALL),
  raw AS (SELECT query_id, p_partkey, field, round(sum(ln(1 + (n.n - df + 0.5) / (df + 0.5)) * tf * 2.2
      / (tf + 1.2 * (0.25 + 0.75 * length / average))), 8) AS raw
    FROM ft JOIN qt USING (term) JOIN len USING (p_partkey, field) JOIN av USING (field) JOIN df USING (field, term), n GROUP BY ALL),
  norm AS (SELECT *, CASE WHEN max(raw) OVER (PARTITION BY query_id, field) > 0
    THEN raw / max(raw) OVER (PARTITION BY query_id, field) ELSE 0 END AS normalized FROM raw),
  bonus AS (SELECT query_id, p_partkey, field, least(count(*) * 0.08, 0.48) * {_BONUS} AS bonus
    FROM ft JOIN qt USING (term) GROUP BY query_id, p_partkey, field),
  comb AS (SELECT query_id, p_partkey, round(sum(normalized * {_WEIGHTS}) + sum(bonus), 6) AS score,
    list_sort(list(field)) AS matched_fields FROM norm JOIN bonus USING (query_id, p_partkey, field) GROUP BY ALL)"""


def field_inputs(t: Tables):
    """One query per part type: the type's words and the words of its first part's name."""
    long = fields.long_fields(t.part, "p_partkey", {n: F.col(c) for n, c in FIELD_COLUMNS.items()})
    tokens = fields.field_tokens(long, "p_partkey")
    asked = t.part.groupBy("p_type").agg(F.min_by("p_name", "p_partkey").alias("p_name"))
    terms = asked.select(
        F.col("p_type").alias("query_id"), F.explode(F.array_distinct(tx.tokens(F.concat_ws(" ", "p_name", "p_type")))).alias("term")
    ).withColumn("category", F.lit("term"))
    return tokens, terms, is_bounded(terms, BROADCAST_ROWS)


@query(
    "field_normalisation",
    f"WITH {FIELDS_SQL} SELECT query_id, field, round(max(raw), 6) AS best_raw, count(*) AS n_hits, round(avg(normalized), 6) AS mean_normalized FROM norm GROUP BY ALL",
)
def _(t: Tables) -> DataFrame:
    tokens, terms, few = field_inputs(t)
    scores = fields.score_fields(
        tokens, t.part, terms, "query_id", "p_partkey", presets.FIELD_WEIGHTS, few_query_terms=few
    )
    return scores.groupBy("query_id", "field").agg(
        F.round(F.max("raw"), 6).alias("best_raw"), F.count("*").alias("n_hits"),
        F.round(F.avg("normalized"), 6).alias("mean_normalized"),
    )


@query(
    "field_bm25_topk",
    f"""WITH {FIELDS_SQL} SELECT query_id, p_partkey, score, array_to_string(matched_fields, ',') AS matched_fields,
    row_number() OVER (PARTITION BY query_id ORDER BY score DESC, p_partkey) AS rank FROM comb QUALIFY rank <= 50""",
)
def _(t: Tables) -> DataFrame:
    tokens, terms, few = field_inputs(t)
    scores = fields.score_fields(tokens, t.part, terms, "query_id", "p_partkey", few_query_terms=few)
    matches = fields.exact_matches(tokens, t.part, terms, "query_id", "p_partkey", few)
    combined = fields.combine(scores, matches, "query_id", "p_partkey").select(
        "query_id", "p_partkey", "score", F.array_join("matched_fields", ",").alias("matched_fields")
    )
    return ranking.top_k(combined, ["query_id"], [F.desc("score"), F.col("p_partkey")], 50)


# ---- order, pages, aggregates ----------------------------------------------------------------------
@query(
    "sort_modes",
    f"""WITH {SPANS_SQL}, r AS (SELECT s.*, o_orderpriority AS client, row_number() OVER (ORDER BY o_totalprice DESC, order_id) AS relevance_rank
      FROM spans s JOIN orders ON o_orderkey = order_id)
    SELECT order_id, relevance_rank, row_number() OVER (ORDER BY coalesce(end_year, start_year, -1) DESC, relevance_rank) AS newest_rank,
      row_number() OVER (ORDER BY coalesce(start_year, 9999), relevance_rank) AS oldest_rank,
      row_number() OVER (ORDER BY {sql_fold('client')}, relevance_rank) AS client_rank FROM r""",
)
def _(t: Tables) -> DataFrame:
    rows = order_spans(t).join(
        t.orders.select(F.col("o_orderkey").alias("order_id"), "o_totalprice", F.col("o_orderpriority").alias("client")),
        "order_id",
    )
    ranked = ranking.row_numbers(rows, [F.desc("o_totalprice"), F.col("order_id")], "relevance_rank")
    for mode in ("newest", "oldest", "client"):
        ranked = ranking.row_numbers(ranked, gates.sort_order(mode), f"{mode}_rank")
    return ranked.select("order_id", "relevance_rank", "newest_rank", "oldest_rank", "client_rank")


@query(
    "pagination",
    """WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part)
    SELECT ((rank - 1) // 20 + 1)::BIGINT AS page, count(*) AS n_rows, min(rank) AS first_rank, max(rank) AS last_rank,
      arg_min(p_partkey, rank) AS first_part, (SELECT ceil(count(*) / 20)::BIGINT FROM part) AS total_pages FROM r GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    ranked = ranking.row_numbers(t.part.select("p_partkey", "p_retailprice"), [F.desc("p_retailprice"), F.col("p_partkey")])
    total = F.lit(t.part.agg(F.count("*").alias("n")).scalar())
    return ranked.groupBy((F.floor((F.col("rank") - 1) / 20) + 1).alias("page")).agg(
        F.count("*").alias("n_rows"), F.min("rank").alias("first_rank"), F.max("rank").alias("last_rank"),
        F.min_by("p_partkey", "rank").alias("first_part"),
    ).withColumn("total_pages", ranking.page_count(total, 20))


@query(
    "result_page",
    """SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part QUALIFY rank BETWEEN 41 AND 60""",
)
def _(t: Tables) -> DataFrame:
    ranked = ranking.row_numbers(t.part.select("p_partkey", "p_retailprice"), [F.desc("p_retailprice"), F.col("p_partkey")])
    return ranking.page_of(ranked, 3, 20).select("p_partkey", "rank")


@query(
    "sequential_ids",
    """SELECT event_id, 'EV-' || lpad((row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id))::VARCHAR, 8, '0') AS item_id, event_type FROM events""",
)
def _(t: Tables) -> DataFrame:
    ranked = ranking.row_numbers(t.events.select("event_id", "event_type", "ts"), ["ts", "event_id"], "n", ["event_type"])
    return ranked.select("event_id", F.format_string("EV-%08d", "n").alias("item_id"), "event_type")


@query(
    "latency_percentiles",
    """SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean
    FROM events GROUP BY event_type""",
)
def _(t: Tables) -> DataFrame:
    points = metrics.quantiles_by(t.events, ["event_type"], "value", p50=0.5, p95=0.95)
    means = t.events.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"))
    return points.select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95")).join(means, "event_type")


@query(
    "run_summary",
    """WITH r AS (SELECT event_type = 'error' AS no_answer, user_id % 3 = 0 AS crosses, json_extract(props, '$.k')::INT % 4 AS n, value FROM events)
    SELECT count(*) AS evaluated_queries, count(*) FILTER (no_answer) AS no_answer_queries, count(*) FILTER (NOT no_answer) AS answerable_queries,
      round(count(*) FILTER (no_answer AND n > 0) / count(*) FILTER (no_answer), 6) AS no_answer_false_positive_rate,
      round(count(*) FILTER (NOT no_answer AND n = 0) / count(*) FILTER (NOT no_answer), 6) AS answerable_zero_result_rate,
      count(*) FILTER (crosses) AS cross_language_sample_count,
      round(quantile_cont(value, 0.5), 2) AS p50_latency_ms, round(quantile_cont(value, 0.95), 2) AS p95_latency_ms FROM r""",
)
def _(t: Tables) -> DataFrame:
    runs = t.events.select(
        F.when(F.col("event_type") == "error", "Yes").otherwise("no").alias("no_answer_expected"),
        F.when(F.col("user_id") % 3 == 0, "TRUE").otherwise("").alias("cross_language_expected"),
        (F.get_json_object("props", "$.k").cast("int") % 4).alias("result_count"),
        F.col("value").alias("latency_ms"),
    )
    return metrics.run_summary(runs)


@query(
    "json_values",
    """SELECT event_id, ['{"k": ' || k || '}', k::VARCHAR] AS vals, len(['{"k": ' || k || '}', k::VARCHAR]) AS n_values
    FROM (SELECT event_id, json_extract(props, '$.k')::INT AS k FROM events)""",
)
def _(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    listed = F.to_json(F.array(F.col("props"), F.concat(F.lit("  "), k), k, F.lit(" ")))
    rows = t.events.select("event_id", tx.json_strings(listed).alias("vals"))
    return rows.withColumn("n_values", F.size("vals"))


@query(
    "null_word_cleanup",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderpriority END AS cleaned,
    trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9_]+', ' ', 'g')) AS facet FROM orders""",
)
def _(t: Tables) -> DataFrame:
    words = F.array(*[F.lit(w) for w in ("nan", " N/A ", "#VALUE!", "None")])
    raw = F.when(
        F.col("o_orderkey") % 7 == 0, F.get(words, F.pmod("o_orderkey", F.lit(4)).cast("int"))
    ).otherwise(F.concat(F.lit(" \t"), F.replace("o_orderpriority", F.lit(" "), F.lit(" \n ")), F.lit("  ")))
    return t.orders.select("o_orderkey", tx.clean(raw).alias("cleaned"), tx.facet_key("o_orderpriority").alias("facet"))


@query(
    "best_per_user",
    """SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events QUALIFY rank <= 3""",
)
def _(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_id", "value")
    return ranking.top_k(rows, ["user_id"], [F.desc("value"), F.col("event_id")], 3)


@query(
    "match_reasons",
    """WITH r AS (SELECT p_partkey, list_filter([
      CASE WHEN contains(' ' || p_name || ' ', ' ring ') THEN 'Confirmed technology or capability: ring' END,
      CASE WHEN p_type IN ('ECONOMY', 'SMALL', 'RING') THEN 'Matching offering: ' || p_type END,
      CASE WHEN contains(' ' || p_name || ' ', ' small ') OR contains(' ' || p_name || ' ', ' ring ') THEN 'Matching capability: ' ||
        array_to_string(list_filter(['small', 'ring'], lambda w: contains(' ' || p_name || ' ', ' ' || w || ' ')), ',') END,
      CASE WHEN p_size >= 35 THEN 'Semantic similarity: ' END,
      CASE WHEN p_size % 2 = 0 THEN 'Confirmed delivery evidence: ' || p_brand END], lambda x: x IS NOT NULL) AS reasons FROM part)
    SELECT p_partkey, array_to_string(reasons, '|') AS reasons, len(reasons) AS n_reasons FROM r""",
)
def _(t: Tables) -> DataFrame:
    """Parts as results of the request "small ring economy"."""
    asked = (("small", "small", "term"), ("ring", "ring", "technology"), ("economy", "Economy", "term"))
    terms = F.array(
        *[F.struct(F.lit(a).alias("term"), F.lit(b).alias("display"), F.lit(c).alias("category")) for a, b, c in asked]
    )
    rows = t.part.select(
        "p_partkey", terms.alias("query_terms"), tx.tokens("p_name").alias("exact_terms"), F.col("p_type").alias("offering"),
        F.lit("").alias("sector"), F.col("p_name").alias("service_nature"), (F.col("p_size") / 50).alias("best_dense"),
        F.lit("en").alias("query_language"), F.lit("en").alias("evidence_language"), F.lit("").alias("display_text"),
        F.col("p_brand").alias("citation_label"), (F.col("p_size") % 2 == 0).alias("project_delivery_signal"),
    )
    found = rows.withColumn("r", reasons.match_reasons())
    shown = F.transform("r", lambda x: F.concat(x["category"], F.lit(": "), F.array_join(x["values"], ",")))
    return found.select("p_partkey", F.array_join(shown, "|").alias("reasons"), F.size("r").alias("n_reasons"))
