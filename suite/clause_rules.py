"""Clauses of the documents' texts, and how far the turns of a conversation take them up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekgrain.functions import clauses
from suite.base import Tables, query, sql_fold, sql_list

#: Words of the given tables' invented prose, in place of activity words and unfinished ends.
ACTIONS, UNFINISHED, JOINING = ("thble", "nicht", r"the\s+thtion"), ("the", "und", r"of\s+the"), ("the", "und")


def found(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", clauses.activity_clauses("text", ACTIONS, UNFINISHED, JOINING).alias("found"))


_TRIM = "regexp_replace({0}, '^[ \\-:;]+|[ \\-:;]+$', '', 'g')"
_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
#: Words that only begin like an activity word are set apart by a mark, as the pattern language knows no look-ahead.
_MARKED = f"regexp_replace(coalesce(text, ''), '(\\s)((?:{'|'.join(ACTIONS)})[\\p{{L}}\\p{{N}}_])', '\\1' || chr(2) || '\\2', 'gi')"
_CUT = f"""replace(regexp_replace(regexp_replace({_MARKED}, '\\s*[•▪·]\\s*|\\s*;\\s*', chr(1), 'g'),
    '\\s+((?:{'|'.join(ACTIONS)})\\b)', chr(1) || '\\1', 'gi'), chr(2), '')"""


def _ends(text: str, words) -> str:
    return f"regexp_matches({text}, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])(?:{'|'.join(words)})$')"


CLAUSES_SQL = f"""WITH RECURSIVE pieces AS MATERIALIZED (SELECT doc_id, list_transform(list_filter(list_transform(string_split({_CUT}, chr(1)),
      lambda p: {_STRIP.format('p')}), lambda p: p <> ''), lambda p: {_TRIM.format('left(p, 260)')}) AS ps FROM documents),
  fold AS (SELECT doc_id, ps, 1 AS i, []::VARCHAR[] AS done, '' AS open FROM pieces
    UNION ALL SELECT doc_id, ps, i + 1, CASE WHEN goes_on THEN done ELSE list_append(done, clause) END, CASE WHEN goes_on THEN clause ELSE '' END
    FROM (SELECT *, NOT regexp_matches(clause, '\\S\\s+\\S') OR {_ends('clause', UNFINISHED)} AS goes_on
      FROM (SELECT *, {_STRIP.format("concat_ws(' ', open, ps[i])")} AS clause FROM fold WHERE i <= len(ps)))),
  whole AS MATERIALIZED (SELECT doc_id, CASE WHEN open = '' THEN done WHEN len(done) = 0 THEN [open]
    ELSE list_append(list_slice(done, 1, len(done) - 1), trim(done[-1] || ' ' || open)) END AS cs FROM fold WHERE i = len(ps) + 1),
  once AS MATERIALIZED (SELECT doc_id, list_filter(cs, lambda c, i: list_position(cs, c) = i) AS cs FROM whole),
  fewer AS (SELECT doc_id, cs FROM once
    UNION ALL SELECT doc_id, list_concat(list_slice(cs, 1, pos - 1), [left(cs[pos] || CASE WHEN {_ends('cs[pos]', JOINING)} THEN ' ' ELSE '; ' END || cs[pos + 1],
      360)], list_slice(cs, pos + 2, len(cs))) FROM (SELECT *, list_position(sums, list_min(sums)) AS pos FROM (SELECT *,
      list_transform(range(1, len(cs)), lambda j: length(cs[j]) + length(cs[j + 1])) AS sums FROM fewer WHERE len(cs) > {clauses.CLAUSES}))),
  found AS (SELECT doc_id, cs FROM fewer WHERE len(cs) <= {clauses.CLAUSES})"""


@query("activity_clauses", f"{CLAUSES_SQL} SELECT doc_id, len(cs) AS n_clauses, array_to_string(cs, chr(10)) AS clauses FROM found")
def _(t: Tables) -> DataFrame:
    return found(t).select("doc_id", F.size("found").alias("n_clauses"), F.array_join("found", "\n").alias("clauses"))


def _telling(text: str) -> str:
    words = f"list_distinct(regexp_extract_all({sql_fold(text)}, '[a-z0-9]{{3,}}'))"
    return f"list_filter({words}, lambda w: NOT list_contains({sql_list(clauses.COMMON)}, w))"


@query(
    "clause_coverage",
    f"""{CLAUSES_SQL}, needed AS (SELECT doc_id, place, words FROM (SELECT doc_id, place, {_telling('c')} AS words
      FROM (SELECT doc_id, unnest(cs) AS c, unnest(range(len(cs))) AS place FROM found)) WHERE len(words) >= 2),
    held AS (SELECT conv_id AS doc_id, {_telling('text')} AS held FROM conversations WHERE text IS NOT NULL),
    best AS (SELECT n.doc_id, n.place, n.words, coalesce(max(len(list_intersect(words, held))), 0) / len(words) >= 0.2 AS covered
      FROM needed n LEFT JOIN held USING (doc_id) GROUP BY n.doc_id, n.place, n.words)
    SELECT doc_id, count(place) AS n_clauses, count(*) FILTER (covered) AS n_covered,
      count(place) = 0 OR count(*) FILTER (covered) >= 0.5 * count(place) AS sufficient
    FROM documents LEFT JOIN best USING (doc_id) GROUP BY doc_id""",
)
def _(t: Tables) -> DataFrame:
    turns = t.conversations.groupBy(F.col("conv_id").alias("doc_id")).agg(F.collect_list("text").alias("turns"))
    rows = found(t).join(turns, "doc_id", "left")
    return rows.select("doc_id", clauses.clause_coverage(F.col("found"), F.col("turns")).alias("c")).select("doc_id", "c.*")
