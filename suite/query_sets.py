"""Sets of evaluation queries: copies of corpus texts, validation, digests and changed cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekgrain.functions import text as texts
from seekgrain.operators import containment, query_sets
from suite.base import Tables, query, sql_fold

EXPECTED = 45


def corpus(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "text")


def query_set(t: Tables) -> DataFrame:
    """``benchmark`` and the names of ``nation`` read as a query sheet in which every check fails somewhere."""
    n = F.col("n")
    passages = t.benchmark.select(F.col("item_id").alias("n"), "text")
    names = t.nation.select((F.col("n_nationkey") + 1000).alias("n"), F.col("n_name").alias("text"))
    rows = passages.unionByName(names)
    return rows.select(
        F.format_string("DEV-%03d", F.when(n < 1000, n + 1 - (n == 7).cast("int")).otherwise(n - 960)).alias("query_id"),
        F.when(n % 11 == 3, " ").when(n == 1004, "Brazil").otherwise(F.col("text")).alias("query_text"),
        F.when(n % 13 == 5, "xx").when(n % 5 == 1, "mixed").otherwise("en").alias("language"),
        F.when(n % 7 == 2, "answerable|no_answer").when(n % 7 == 3, "answerable|odd").when(n % 5 == 1, "direct|no_answer")
        .otherwise("answerable| direct").alias("query_type"),
        F.when(n % 17 == 4, "no").otherwise(" yes").alias("approved"),
        F.lit("YES").alias("not_derived"),
        F.when(n % 19 == 6, "=1+1").otherwise("fine").alias("notes"),
    )


QUERY_SET_SQL = """q AS (SELECT printf('DEV-%03d', CASE WHEN n < 1000 THEN n + 1 - (n = 7)::INT ELSE n - 960 END) AS query_id,
    CASE WHEN n % 11 = 3 THEN ' ' WHEN n = 1004 THEN 'Brazil' ELSE text END AS query_text, n
    FROM (SELECT item_id AS n, text FROM benchmark UNION ALL SELECT n_nationkey + 1000, n_name FROM nation))"""


@query(
    "contained_texts",
    f"""WITH b AS (SELECT item_id, {sql_fold('text')} AS f FROM benchmark WHERE text <> ''),
    d AS (SELECT doc_id, {sql_fold('text')} AS f FROM documents WHERE text <> '')
    SELECT item_id, doc_id, CASE WHEN b.f = d.f THEN 'equal' ELSE 'contains' END AS relation FROM b, d
    WHERE b.f = d.f OR (length(b.f) >= 80 AND contains(d.f, b.f))""",
)
def _(t: Tables) -> DataFrame:
    asked = t.benchmark.select("item_id", texts.fold("text").alias("form"))
    held = t.documents.select("doc_id", texts.fold("text").alias("form"))
    found = containment.contained_texts(asked, "item_id", "form", held, "doc_id", "form")
    return found.select(F.col("needle_id").alias("item_id"), F.col("text_id").alias("doc_id"), "relation")


@query(
    "query_set_checks",
    f"""WITH {QUERY_SET_SQL}, f AS (SELECT *, {sql_fold('query_text')} AS form FROM q),
    d AS (SELECT {sql_fold('text')} AS form FROM documents WHERE text <> ''),
    w AS (SELECT printf('DEV-%03d', i) AS query_id FROM range(1, {EXPECTED + 1}) r(i))
    SELECT 'row_count' AS check_name, abs(count(*) - {EXPECTED}) AS n_issues FROM q
    UNION ALL SELECT 'unsupported_language', count(*) FILTER (n % 13 = 5) FROM q
    UNION ALL SELECT 'empty_text', count(*) FILTER (trim(query_text) = '') FROM q
    UNION ALL SELECT 'invalid_tags', count(*) FILTER (n % 7 IN (2, 3) OR (n % 5 = 1 AND n % 13 <> 5)) FROM q
    UNION ALL SELECT 'not_approved', count(*) FILTER (n % 17 = 4) FROM q
    UNION ALL SELECT 'formula_content', count(*) FILTER (n % 19 = 6) FROM q
    UNION ALL SELECT 'missing_id', count(*) FROM w WHERE query_id NOT IN (SELECT query_id FROM q)
    UNION ALL SELECT 'unexpected_id', count(DISTINCT query_id) FROM q WHERE query_id NOT IN (SELECT query_id FROM w)
    UNION ALL SELECT 'duplicate_id', count(*) FROM (SELECT query_id FROM q GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'duplicate_text', coalesce(sum(c), 0)::BIGINT FROM (SELECT count(*) AS c FROM f WHERE form <> '' GROUP BY form HAVING count(*) > 1)
    UNION ALL SELECT 'direct_copy', count(DISTINCT query_id) FROM f WHERE form <> '' AND EXISTS (
      SELECT 1 FROM d WHERE d.form = f.form OR (length(f.form) >= 80 AND contains(d.form, f.form)))""",
)
def _(t: Tables) -> DataFrame:
    return query_sets.query_set_checks(query_set(t), corpus(t), "doc_id", "text", ["en", "mixed"], EXPECTED, "DEV-")


@query(
    "table_digest",
    """WITH h AS (SELECT sha256('{"doc_id":' || doc_id || ',"quality":' || coalesce(quality::VARCHAR, 'null') || ',"toxic":'
      || coalesce(toxic::VARCHAR, 'null') || '}') AS h FROM labels),
    p AS (SELECT ('0x' || substr(h, 1, 15))::BIGINT AS a, ('0x' || substr(h, 16, 15))::BIGINT AS b,
      ('0x' || substr(h, 31, 15))::BIGINT AS c, ('0x' || substr(h, 46, 15))::BIGINT AS d FROM h)
    SELECT count(*) AS n_rows, sha256(concat_ws(':', count(*), coalesce(sum(a), 0), coalesce(sum(b), 0), coalesce(sum(c), 0), coalesce(sum(d), 0))) AS digest
    FROM p""",
)
def _(t: Tables) -> DataFrame:
    return query_sets.table_digest(t.labels)


@query(
    "changed_cells",
    """WITH b AS (SELECT c_custkey AS k, '-' || c_name AS name, c_acctbal::DOUBLE AS bal, c_mktsegment AS seg FROM customer WHERE c_custkey % 10 <> 1),
    a AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN '''-' || c_name WHEN c_custkey % 3 = 1 THEN '-' || c_name ELSE c_name END AS name,
      c_acctbal::DOUBLE + CASE WHEN c_custkey % 4 = 0 THEN 0.00000001 WHEN c_custkey % 4 = 1 THEN 1 ELSE 0 END AS bal,
      CASE WHEN c_custkey % 6 <> 2 THEN c_mktsegment END AS seg FROM customer WHERE c_custkey % 10 <> 2)
    SELECT coalesce(b.k, a.k) AS c_custkey, column_name, CASE WHEN b.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM b FULL JOIN a ON b.k = a.k, (VALUES ('name'), ('bal'), ('seg')) v(column_name)
    WHERE b.k IS NULL OR a.k IS NULL OR (column_name = 'name' AND b.k % 3 = 2) OR (column_name = 'bal' AND b.k % 4 = 1)
      OR (column_name = 'seg' AND b.k % 6 = 2)""",
)
def _(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    name, balance = F.concat(F.lit("-"), "c_name"), F.col("c_acctbal").cast("double")
    before = t.customer.filter(k % 10 != 1).select(k, name.alias("name"), balance.alias("bal"), F.col("c_mktsegment").alias("seg"))
    after = t.customer.filter(k % 10 != 2).select(
        k,
        F.when(k % 3 == 0, F.concat(F.lit("'"), name)).when(k % 3 == 1, name).otherwise(F.col("c_name")).alias("name"),
        (balance + F.when(k % 4 == 0, 1e-8).when(k % 4 == 1, 1.0).otherwise(0.0)).alias("bal"),
        F.when(k % 6 != 2, F.col("c_mktsegment")).alias("seg"),
    )
    return query_sets.changed_cells(before, after, "c_custkey", ["name", "bal", "seg"], 1e-6).select("c_custkey", "column_name", "change")
