"""Turns of conversations as written copy, and the document with the number of the conversation as its trusted source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekgrain.functions import repairs
from seekgrain.operators import anchors, support_links
from suite.base import Tables, query, sql_fold, sql_list

#: Invented prose ends with a full stop; without it some texts end in a connector.
_TEXT = "regexp_replace(text, '\\.$', '')"
_SQUEEZED = "trim(regexp_replace(t, '\\s+', ' ', 'g'))"
_EDGE = "regexp_replace({0}, '[ ,;:\\-]+$', '')"
_BOTH = "regexp_replace({0}, '^[ ,;:\\-]+|[ ,;:\\-]+$', '', 'g')"
_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


def _plain(part: str) -> str:
    return f"list_transform({part}, lambda w: regexp_replace({sql_fold('w')}, '[^a-z0-9]', '', 'g'))"


_ECHO = " ".join(
    f"WHEN len(ws) >= {max(5, 2 * n)} AND {_plain(f'list_slice(ws, 1, {n})')} = {_plain(f'list_slice(ws, len(ws) - {n - 1}, len(ws))')} THEN {n}"
    for n in range(5, 0, -1)
)
_PUNCTUATED = _BOTH.format("regexp_replace(regexp_replace({0}, '\\s+([.,;])', '\\1', 'g'), '\\s{{2,}}', ' ', 'g')")
_PERSON = "t"
for _pattern in repairs.PERSONS:
    _PERSON = f"regexp_replace({_PERSON}, '(?i){_pattern}', '', 'g')"
_TAIL = f"(?i)(?:\\s|^)?(?:(?:\\s|^)(?:{'|'.join(repairs.DANGLING)})\\s*[ ,;:\\-]*)+$".replace("'", "''")
_FOREIGN = _STRIP.format(_EDGE.format("regexp_replace(regexp_replace(t, '[^\\P{L}\\p{Latin}]', ' ', 'g'), '\\s{2,}', ' ', 'g')"))


@query(
    "copy_repairs",
    f"""WITH turns AS (SELECT conv_id, turn, {_TEXT} AS t, string_split({_SQUEEZED.replace('(t,', f'({_TEXT},')}, ' ') AS ws FROM conversations),
      cut AS (SELECT *, CASE {_ECHO} ELSE 0 END AS n FROM turns)
    SELECT conv_id, turn, CASE WHEN n = 0 THEN array_to_string(ws, ' ')
        ELSE {_EDGE.format("array_to_string(list_slice(ws, 1, len(ws) - n), ' ')")} END AS no_echo,
      CASE WHEN regexp_matches({_STRIP.format('t')}, '{_TAIL}') THEN {_EDGE.format(f"regexp_replace({_STRIP.format('t')}, '{_TAIL}', '')")}
        ELSE {_STRIP.format('t')} END AS whole_end,
      CASE WHEN conv_id % 2 = 0 THEN {_FOREIGN} ELSE {_STRIP.format('t')} END AS one_script, {_PUNCTUATED.format(_PERSON)} AS no_person
    FROM cut""",
)
def _(t: Tables) -> DataFrame:
    text = F.regexp_replace("text", r"\.$", "")
    french = F.when(F.col("conv_id") % 2 == 0, "fr").otherwise("en")
    return t.conversations.select(
        "conv_id", "turn", repairs.without_echo(text).alias("no_echo"), repairs.without_dangling_end(text).alias("whole_end"),
        repairs.without_foreign_letters(text, french).alias("one_script"), repairs.without_persons(text).alias("no_person"),
    )


def _words(text: str, pattern: str) -> str:
    return f"list_distinct(regexp_extract_all({sql_fold(text)}, '{pattern}'))"


_LACK = "|".join(anchors.LACKS)


@query(
    "entailed_turns",
    f"""WITH held AS (SELECT DISTINCT doc_id, unnest({_words('text', '[a-z0-9]{4,}')}) AS word FROM documents),
      named AS (SELECT doc_id, bool_or(regexp_matches({sql_fold('text')}, '\\b(?:{_LACK})\\b')) AS named FROM documents GROUP BY doc_id),
      asked AS (SELECT conv_id, turn, unnest({_words('text', '[a-z0-9]{4,}')}) AS word FROM conversations),
      counts AS (SELECT conv_id, turn, count(*) AS n_words, count(*) FILTER (doc_id IS NULL AND
        NOT list_contains({sql_list(anchors.REWRITE_WORDS)}, asked.word)) AS n_unknown
        FROM asked LEFT JOIN held ON doc_id = conv_id AND held.word = asked.word GROUP BY conv_id, turn)
    SELECT conv_id, turn, coalesce(n_words, 0) AS n_words, coalesce(n_unknown, 0) AS n_unknown, role <> 'assistant' OR (
      (coalesce(n_unknown, 0) < 2 OR coalesce(n_unknown, 0) / greatest(coalesce(n_words, 0), 1) <= 0.2)
      AND NOT regexp_matches(coalesce({sql_fold('text')}, ''), '{'|'.join(anchors.UNSUPPORTED)}')
      AND (NOT regexp_matches(coalesce({sql_fold('text')}, ''), '^(?:{_LACK})\\b') OR coalesce(named, false))) AS entailed
    FROM conversations LEFT JOIN counts USING (conv_id, turn) LEFT JOIN named ON doc_id = conv_id""",
)
def _(t: Tables) -> DataFrame:
    trusted = t.documents.withColumnRenamed("doc_id", "conv_id")
    return anchors.entailment(
        t.conversations, ["conv_id", "turn"], "text", trusted, "conv_id", "text", applies=F.col("role") == "assistant"
    )


_ANCHOR = f"list_filter({_words('text', '[\\p{L}\\p{N}]{2,}')}, lambda w: NOT list_contains({sql_list(anchors.NO_ANCHORS)}, w) AND NOT regexp_matches(w, '^\\d+$'))"


@query(
    "anchored_turns",
    f"""WITH held AS (SELECT DISTINCT doc_id, unnest({_ANCHOR}) AS s FROM documents),
      asked AS (SELECT conv_id, turn, unnest({_ANCHOR}) AS v FROM conversations),
      hits AS (SELECT DISTINCT conv_id, turn FROM asked JOIN held ON doc_id = conv_id AND left(v, 2) = left(s, 2)
        WHERE v = s OR (length(v) >= 5 AND length(s) >= 5 AND (starts_with(v, s) OR starts_with(s, v))))
    SELECT c.conv_id, c.turn, h.conv_id IS NOT NULL AS anchored
    FROM conversations c LEFT JOIN hits h ON h.conv_id = c.conv_id AND h.turn = c.turn""",
)
def _(t: Tables) -> DataFrame:
    trusted = t.documents.withColumnRenamed("doc_id", "conv_id")
    return anchors.anchored(t.conversations, ["conv_id", "turn"], "text", trusted, "conv_id", "text")


@query(
    "support_evidence",
    """SELECT s.doc_id, coalesce(min(e.doc_id), -1) AS evidence_id FROM documents s LEFT JOIN (SELECT d.* FROM documents d JOIN labels USING (doc_id)) e
      ON e.lang = s.lang AND e.n_chars = s.n_chars AND e.text = s.text GROUP BY s.doc_id""",
)
def _(t: Tables) -> DataFrame:
    labelled = t.documents.join(t.labels.select("doc_id").distinct(), "doc_id", "left_semi")
    found = support_links.first_equal_evidence(t.documents, "doc_id", labelled, "doc_id", ["lang", "n_chars"], "text")
    return found.withColumn("evidence_id", F.coalesce("evidence_id", F.lit(-1)))
