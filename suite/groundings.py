"""Grounding and export checks, with documents as claims and as their supports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekgrain.functions import language
from seekgrain.operators import grounding, ranking, trusted
from suite.base import Tables, query, sql_fold, sql_list
from suite.corpus import DOCUMENT_TYPES


def supports(t: Tables) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in DOCUMENT_TYPES])
    return t.documents.select(
        F.concat(F.lit("S"), "doc_id").alias("support_id"),
        F.col("source").alias("reference_id"),
        grounding.support_types(F.get(kinds, F.pmod("n_chars", F.lit(5)).cast("int"))).alias("support_types"),
        "text",
    )


def claims(t: Tables) -> DataFrame:
    """Every document claims what the next document of the table should support."""
    return t.documents.select(
        F.col("doc_id").alias("claim_id"),
        F.col("source").alias("reference_id"),
        F.when(F.pmod("doc_id", F.lit(3)) == 0, F.concat(F.lit("references["), "source", F.lit("].benefits[0]")))
        .otherwise(F.concat(F.lit("references["), "source", F.lit("].realisations[0]"))).alias("field_path"),
        "text",
        F.when(F.pmod("doc_id", F.lit(11)) == 0, F.array().cast("array<string>"))
        .otherwise(F.array(F.concat(F.lit("S"), (F.col("doc_id") + 1).cast("string")))).alias("support_ids"),
        F.when(F.pmod("doc_id", F.lit(7)) == 0, F.array(F.lit("S0"))).alias("planned_ids"),
    )


def selected(t: Tables) -> DataFrame:
    return t.documents.select(F.col("source").alias("reference_id")).distinct().filter("reference_id <> 'src7'")


def fact_texts(t: Tables) -> DataFrame:
    return t.documents.select("source").distinct().select(F.col("source").alias("reference_id"), F.col("source").alias("fact_text"))


@query("claim_findings")
def _(t: Tables) -> DataFrame:
    return grounding.validate_claims(claims(t), supports(t), selected(t), fact_texts(t))


SQL_NUMBERS = (
    "list_distinct(list_transform(regexp_extract_all({0}, '(?:^|[^\\p{{L}}\\p{{N}}_])(\\p{{Nd}}+(?:[.,]\\p{{Nd}}+)?(?:\\s*%)?)', 1), "
    "lambda n: replace(replace(n, ' ', ''), ',', '.')))"
)
CLAIMS_SQL = f"""c AS (SELECT doc_id AS claim_id, source AS reference_id, text, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE doc_id + 1 END AS cited,
    CASE WHEN doc_id % 7 = 0 THEN 'S0' END AS planned FROM documents),
  j AS (SELECT c.*, s.doc_id AS found, s.source AS support_source, s.text AS support, s.n_chars % 5 AS kind FROM c LEFT JOIN documents s ON s.doc_id = c.cited),
  nums AS (SELECT claim_id, unnest(list_filter({SQL_NUMBERS.format('text')}, lambda n: NOT list_contains({SQL_NUMBERS.format("coalesce(support, '')")}, n))) AS n FROM j)"""
CHECKED_CODES = (
    "UNSUPPORTED_PERCENTAGE", "UNSUPPORTED_YEAR", "UNSUPPORTED_NUMBER", "UNKNOWN_SUPPORT_ID", "UNSELECTED_REFERENCE_SUPPORT",
    "WRONG_REFERENCE_SUPPORT", "MISSING_SUPPORT", "WEAK_SOURCE_SUPPORT", "PROVENANCE_PLAN_MISMATCH",
)


@query(
    "claim_support_findings",
    f"""WITH {CLAIMS_SQL}
    SELECT claim_id, code, 'BLOCKING' AS severity, n AS detail FROM (SELECT claim_id, n, CASE WHEN n LIKE '%\\%' ESCAPE '\\' THEN 'UNSUPPORTED_PERCENTAGE'
      WHEN regexp_full_match(n, '[0-9]{{4}}') AND n::INT BETWEEN 1900 AND 2099 THEN 'UNSUPPORTED_YEAR' ELSE 'UNSUPPORTED_NUMBER' END AS code FROM nums)
      QUALIFY row_number() OVER (PARTITION BY claim_id, code ORDER BY n) = 1
    UNION ALL SELECT claim_id, 'UNKNOWN_SUPPORT_ID', 'BLOCKING', 'S' || cited FROM j WHERE cited IS NOT NULL AND found IS NULL
    UNION ALL SELECT claim_id, 'UNSELECTED_REFERENCE_SUPPORT', 'BLOCKING', 'S' || cited FROM j WHERE support_source = 'src7'
    UNION ALL SELECT claim_id, 'WRONG_REFERENCE_SUPPORT', 'BLOCKING', 'S' || cited FROM j WHERE support_source <> reference_id
    UNION ALL SELECT claim_id, 'MISSING_SUPPORT', 'BLOCKING', NULL FROM j WHERE cited IS NULL
    UNION ALL SELECT claim_id, 'WEAK_SOURCE_SUPPORT', 'WARNING', NULL FROM j WHERE found IS NOT NULL AND kind <> 0
    UNION ALL SELECT claim_id, 'PROVENANCE_PLAN_MISMATCH', 'BLOCKING', NULL FROM j WHERE planned IS NOT NULL AND planned IS DISTINCT FROM ('S' || cited)""",
)
def _(t: Tables) -> DataFrame:
    found = grounding.validate_claims(claims(t), supports(t), selected(t), fact_texts(t))
    return found.filter(F.col("code").isin(*CHECKED_CODES)).select("claim_id", "code", "severity", "detail")


@query("claim_severities")
def _(t: Tables) -> DataFrame:
    found = grounding.validate_claims(claims(t), supports(t), selected(t), fact_texts(t))
    return grounding.severity_counts(found, "reference_id")


@query(
    "numbers_in_text",
    f"""SELECT doc_id, list_sort({SQL_NUMBERS.format('text')}) AS numbers FROM documents""",
)
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_sort(grounding.numbers(F.col("text"))).alias("numbers"))


_TOKENS = "list_distinct(list_filter(regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}_%]+'), lambda w: length(w) >= 4 AND NOT list_contains({1}, w) AND NOT regexp_full_match(w, '[0-9]+')))"


def _claim_tokens(text: str) -> str:
    return _TOKENS.format(sql_fold(text), sql_list(grounding.CLAIM_STOPWORDS))


@query(
    "claim_overlap",
    f"""WITH {CLAIMS_SQL} SELECT claim_id, round(len(list_intersect({_claim_tokens('text')}, {_claim_tokens("coalesce(support, '')")}))
      / greatest(len({_claim_tokens('text')}), 1), 6) AS covered FROM j""",
)
def _(t: Tables) -> DataFrame:
    rows = grounding.resolve_supports(claims(t), supports(t), selected(t))
    rows = rows.select(
        "claim_id", grounding.claim_tokens(F.col("text")).alias("a"), grounding.claim_tokens(F.col("support_text")).alias("b")
    )
    return rows.select("claim_id", F.round(grounding.overlap_share(F.col("a"), F.col("b")), 6).alias("covered"))


def _sql_words(pattern: str) -> str:
    """A pattern of word beginnings for SQL, without the look-behind."""
    words = pattern[pattern.rindex("(?:") + 3 : -1]
    return f"regexp_matches(text, '(?i)(^|[^\\p{{L}}\\p{{N}}_])({words})')"


FIELD_PLAN_SQL = f"""WITH r AS (SELECT 'S' || doc_id AS support_id, source AS reference_id, n_chars % 5 AS kind,
    {_sql_words(grounding.CHALLENGE_PATTERN)} AS challenge, {_sql_words(grounding.OUTCOME_PATTERN)} AS outcome FROM documents),
  facts AS (SELECT 'F-' || source || '-' || name AS support_id, source AS reference_id, name FROM (SELECT DISTINCT source FROM documents),
    (VALUES ('mission_title'), ('client'), ('offering'), ('sector')) v(name)),
  m AS (SELECT reference_id, support_id, 'headline' AS field, 102 AS o, 2 AS most FROM r WHERE kind = 0
    UNION ALL SELECT reference_id, support_id, 'short_description', 102, 3 FROM r WHERE kind = 0
    UNION ALL SELECT reference_id, support_id, 'challenge', 101, 1 FROM r WHERE kind = 1 AND challenge
    UNION ALL SELECT reference_id, support_id, 'contribution', CASE kind WHEN 0 THEN 101 ELSE 103 END, 1 FROM r WHERE kind <= 1
    UNION ALL SELECT reference_id, support_id, 'realisations', 101, 1 FROM r WHERE kind = 0
    UNION ALL SELECT reference_id, support_id, 'benefits', 101, 1 FROM r WHERE kind = 0 AND outcome
    UNION ALL SELECT reference_id, support_id, 'why_relevant', 103, 2 FROM r WHERE kind = 0
    UNION ALL SELECT reference_id, support_id, 'headline', list_position(['mission_title', 'client'], name), 2 FROM facts WHERE name IN ('mission_title', 'client')
    UNION ALL SELECT reference_id, support_id, 'short_description', list_position(['mission_title', 'client'], name), 3 FROM facts WHERE name IN ('mission_title', 'client')
    UNION ALL SELECT reference_id, support_id, 'why_relevant', list_position(['mission_title', 'offering', 'sector'], name), 2 FROM facts WHERE name <> 'client')
  SELECT reference_id, field, row_number() OVER (PARTITION BY reference_id, field ORDER BY o, support_id) AS position, support_id
  FROM m QUALIFY position <= most"""


@query("field_support_plan", FIELD_PLAN_SQL)
def _(t: Tables) -> DataFrame:
    records = supports(t).withColumn("fact_field", F.lit(None).cast("string"))
    names = F.array(F.lit("mission_title"), F.lit("client"), F.lit("offering"), F.lit("sector"))
    facts = t.documents.select("source").distinct().select(
        F.col("source").alias("reference_id"), F.explode(names).alias("fact_field")
    )
    facts = facts.select(
        F.concat(F.lit("F-"), "reference_id", F.lit("-"), "fact_field").alias("support_id"), "reference_id",
        F.array(F.lit(grounding.FACT)).alias("support_types"), F.lit("fact").alias("text"), "fact_field",
    )
    return grounding.field_plan(records.unionByName(facts))


@query(
    "record_plan_realisations",
    """WITH s AS (SELECT 'S' || doc_id AS support_id, source AS reference_id FROM documents WHERE n_chars % 5 = 0)
    SELECT reference_id, min(support_id) AS support_id FROM s GROUP BY reference_id""",
)
def _(t: Tables) -> DataFrame:
    plan = grounding.field_plan(supports(t).withColumn("fact_field", F.lit(None).cast("string")))
    return plan.filter("field = 'realisations'").select("reference_id", "support_id")


@query(
    "support_types",
    f"""SELECT doc_id, CASE n_chars % 5 WHEN 0 THEN 'CLIENT_ATTESTATION,COMPLETED_WORK_EVIDENCE' WHEN 1 THEN 'CONTRACTUAL_SCOPE' ELSE 'UNVERIFIED_METADATA' END AS types FROM documents""",
)
def _(t: Tables) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in DOCUMENT_TYPES])
    kind = F.get(kinds, F.pmod("n_chars", F.lit(5)).cast("int"))
    return t.documents.select("doc_id", F.array_join(grounding.support_types(kind), ",").alias("types"))


@query(
    "detailed_support_rank",
    """WITH words AS (SELECT source, list_distinct(regexp_extract_all(lower(arg_min(text, doc_id)), '[a-zA-ZÀ-ÖØ-öø-ÿ]{4,}')) AS w
      FROM documents GROUP BY source),
    r AS (SELECT d.source AS reference_id, 'S' || doc_id AS support_id, CASE WHEN n_chars % 5 = 0 THEN 1::BIGINT ELSE 0::BIGINT END AS strong,
      len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-zA-ZÀ-ÖØ-öø-ÿ]{4,}')), w)) AS overlap FROM documents d JOIN words USING (source))
    SELECT *, row_number() OVER (PARTITION BY reference_id ORDER BY strong DESC, overlap DESC, support_id) AS position FROM r""",
)
def _(t: Tables) -> DataFrame:
    """The first document of each source is its catalog text."""
    first = t.documents.groupBy("source").agg(F.min_by("text", "doc_id").alias("text"))
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-zA-ZÀ-ÖØ-öø-ÿ]{4,}"), F.lit(0)))
    ordered = grounding.evidence_order(supports(t), first.select(F.col("source").alias("reference_id"), words.alias("catalog_words")))
    return ranking.row_numbers(
        ordered, [F.desc("strong"), F.desc("overlap"), F.col("support_id")], "position", ["reference_id"]
    )


@query(
    "reference_set_check",
    """WITH g AS (SELECT l_orderkey AS draft_id, l_partkey AS reference_id, min(l_linenumber) AS first_at, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL),
    s AS (SELECT l_orderkey AS draft_id, l_partkey AS reference_id, min(l_linenumber) AS wanted FROM lineitem WHERE l_returnflag <> 'A' GROUP BY ALL),
    b AS (SELECT * FROM g FULL JOIN s USING (draft_id, reference_id)),
    f AS (SELECT draft_id, reference_id, 'UNSELECTED_REFERENCE' AS code FROM b WHERE wanted IS NULL
      UNION ALL SELECT draft_id, reference_id, 'MISSING_SELECTED_REFERENCE' FROM b WHERE first_at IS NULL
      UNION ALL SELECT draft_id, reference_id, 'DUPLICATE_REFERENCE' FROM b WHERE n > 1
      UNION ALL SELECT draft_id, reference_id, 'REFERENCE_ORDER_CHANGED' FROM b WHERE first_at <> wanted
        AND draft_id NOT IN (SELECT draft_id FROM b WHERE wanted IS NULL OR first_at IS NULL))
    SELECT draft_id, code, count(*) AS n_references, min(reference_id) AS first_reference FROM f GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("draft_id"), F.col("l_partkey").alias("reference_id"), F.col("l_linenumber").alias("position"), "l_returnflag"
    )
    asked = rows.filter("l_returnflag <> 'A'").groupBy("draft_id", "reference_id").agg(F.min("position").alias("position"))
    return grounding.reference_set_findings(rows.filter("l_returnflag <> 'N'"), asked)


@query(
    "unsupported_facts",
    """WITH k AS (SELECT DISTINCT p_name AS value, lower(p_name) AS phrase FROM part),
    c AS (SELECT s_suppkey AS claim_id, s_suppkey AS reference_id, ' ' || lower(p_name) || ' for ' || lower(p_type) || ' ' AS padded
      FROM supplier JOIN part ON p_partkey = s_suppkey),
    f AS (SELECT s_suppkey AS reference_id, ' ' || lower(p_name) || ' ' AS allowed FROM supplier JOIN part ON p_partkey = s_suppkey + (s_suppkey % 2))
    SELECT DISTINCT claim_id, 'UNSUPPORTED_OFFERING' AS code, value AS detail FROM c JOIN k ON contains(padded, ' ' || phrase || ' ')
    JOIN f USING (reference_id) WHERE NOT contains(allowed, ' ' || phrase || ' ')""",
)
def _(t: Tables) -> DataFrame:
    known = t.part.select(F.lit("offering").alias("field"), F.col("p_name").alias("value")).distinct()
    told = t.supplier.join(t.part, F.col("p_partkey") == F.col("s_suppkey")).select(
        F.col("s_suppkey").alias("claim_id"), F.col("s_suppkey").alias("reference_id"), F.concat_ws(" for ", "p_name", "p_type").alias("text")
    )
    facts = t.supplier.join(t.part, F.col("p_partkey") == F.col("s_suppkey") + F.col("s_suppkey") % 2).select(
        F.col("s_suppkey").alias("reference_id"), F.col("p_name").alias("fact_text")
    )
    return grounding.unknown_facts(told, known, facts).select("claim_id", "code", "detail")


def _marks(words: str, hints) -> str:
    return f"len(list_filter({words}, lambda w: list_contains({sql_list(hints)}, w)))"


_PROSE = "regexp_extract_all({0}, '[a-zà-öø-ÿ'']+')"
_FR, _EN = language.FRENCH_FUNCTION_WORDS, language.ENGLISH_FUNCTION_WORDS


@query(
    "target_language",
    f"""WITH p AS (SELECT conv_id, turn, {_PROSE.format('lower(text)')} AS ws,
      len(list_filter(list_transform(string_split_regex(lower(text), '[.!?;:\\n]+'), lambda s: {_PROSE.format('s')}),
        lambda s: len(s) >= 7 AND {_marks('s', _EN)} >= 3 AND {_marks('s', _EN)} / greatest({_marks('s', _FR)} + {_marks('s', _EN)}, 1) >= 0.70)) > 0 AS alien
      FROM conversations),
    m AS (SELECT conv_id, turn, alien, {_marks('ws', _FR)} AS fr, {_marks('ws', _EN)} AS en FROM p)
    SELECT conv_id, turn, CASE WHEN alien OR (en >= 4 AND fr + en >= 6 AND fr / (fr + en) < 0.40) THEN 'CLEAR_MISMATCH'
      WHEN fr + en >= 3 AND fr / (fr + en) >= 0.60 THEN 'PASS' ELSE 'UNCERTAIN' END AS status FROM m""",
)
def _(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", language.target_check("text", "fr").alias("status"))


@query(
    "source_richness",
    """SELECT conv_id, CASE WHEN count(*) FILTER (role = 'assistant') >= 3 OR count(*) FILTER (role = 'user') >= 4 OR sum(length(text)) >= 650 THEN 'RICH'
      WHEN count(*) FILTER (role = 'assistant') >= 2 OR count(*) FILTER (role = 'user') >= 2 OR sum(length(text)) >= 240 THEN 'MEDIUM' ELSE 'SPARSE' END AS richness
    FROM conversations GROUP BY conv_id""",
)
def _(t: Tables) -> DataFrame:
    facts = t.conversations.groupBy("conv_id").agg(
        F.count_if(F.col("role") == "assistant").alias("a"), F.count_if(F.col("role") == "user").alias("s"),
        F.sum(F.length("text")).alias("n"),
    )
    return facts.select("conv_id", grounding.richness(F.col("a"), F.col("s"), F.col("n")).alias("richness"))


@query(
    "turn_coverage",
    """WITH t AS (SELECT conv_id, count(*) AS n_turns, count(*) FILTER (length(text) > 0) AS n_filled, count(*) FILTER (role = 'assistant') AS n_answers,
      sum(len(string_split(text, ' ')))::BIGINT AS n_words, max(len(string_split(text, ' '))) AS longest, count(*) - count(DISTINCT lower(text)) AS n_repeats FROM conversations GROUP BY conv_id)
    SELECT conv_id, round(n_answers / greatest(n_turns, 1), 6) AS answer_share, CASE WHEN longest > 80 THEN 'VERBOSE' ELSE 'CONCISE' END AS conciseness,
      n_words, n_repeats, coalesce(round(n_filled / nullif(n_turns, 0), 6), 1.0) AS completeness FROM t""",
)
def _(t: Tables) -> DataFrame:
    words = F.size(F.split("text", " ", -1))
    facts = t.conversations.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"), F.count_if(F.length("text") > 0).alias("n_filled"),
        F.count_if(F.col("role") == "assistant").alias("n_answers"), F.sum(words).alias("n_words"), F.max(words).alias("longest"),
        F.count_distinct(F.lower("text")).alias("n_distinct"),
    )
    return facts.select(
        "conv_id", F.round(F.col("n_answers") / F.greatest("n_turns", F.lit(1)), 6).alias("answer_share"),
        F.when(F.col("longest") > 80, "VERBOSE").otherwise("CONCISE").alias("conciseness"), "n_words",
        (F.col("n_turns") - F.col("n_distinct")).alias("n_repeats"),
        F.coalesce(F.round(F.col("n_filled") / F.nullif("n_turns", F.lit(0)), 6), F.lit(1.0)).alias("completeness"),
    )


# ---- export ---------------------------------------------------------------------------------------------
def export_passages(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id", "left").select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), F.col("source").alias("source_file_name"),
        F.sha2(F.when(F.col("n_chars") % 97 == 0, F.concat("source", F.lit("*"))).otherwise(F.col("source")), 256).alias("source_sha256"),
        F.lit(1).alias("page_number_1_based"), F.lit("p. 1").alias("citation_label"),
        F.when(F.col("n_chars") % 50 == 0, "n/a").otherwise("doc").alias("citation_uri"), F.col("text").alias("display_text"),
        (F.coalesce("toxic", F.lit(0)) == 0).alias("approved_for_retrieval"), (F.coalesce("quality", F.lit(1)) == 1).alias("approved_for_display"),
        F.when(F.col("n_chars") % 3 == 0, "SECRET").otherwise("INTERNAL").alias("security_classification"),
    )


@query(
    "trusted_reference_codes",
    """WITH pass AS (SELECT d.doc_id AS chunk_id, source, coalesce(toxic, 0) = 0 AS kept, n_chars % 3 <> 0 AS open, coalesce(quality, 1) = 1 AS showable,
      n_chars % 50 = 0 OR trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' AS bad, n_chars % 97 = 0 AS other_hash FROM documents d LEFT JOIN labels USING (doc_id)),
    links AS (SELECT DISTINCT l_orderkey AS chunk_id, l_partkey AS row_number FROM lineitem),
    facts AS (SELECT row_number, count(*) AS n_linked, count(*) FILTER (NOT kept) AS n_unapproved, count(*) FILTER (open) AS n_open,
      count(*) FILTER (open AND showable) AS n_shown, count(*) FILTER (open AND showable AND bad) AS n_bad FROM links JOIN pass USING (chunk_id) GROUP BY 1),
    hashes AS (SELECT row_number, max(n) AS n_hashes FROM (SELECT row_number, source, count(DISTINCT other_hash) AS n FROM links JOIN pass USING (chunk_id) WHERE open AND showable GROUP BY ALL) GROUP BY 1)
    SELECT 'R' || p_partkey AS reference_id, CASE WHEN p_size <= 5 THEN CASE WHEN p_size <= 2 AND coalesce(n_linked, 0) = 0 THEN 'REFERENCE_QUARANTINED' ELSE 'REFERENCE_NOT_RETRIEVAL_APPROVED' END
      WHEN coalesce(n_linked, 0) = 0 THEN 'REFERENCE_WITHOUT_EVIDENCE' WHEN n_unapproved > 0 THEN 'REFERENCE_NOT_RETRIEVAL_APPROVED' WHEN n_open = 0 THEN 'REFERENCE_NOT_AUTHORIZED'
      WHEN n_shown = 0 THEN 'DISPLAY_EVIDENCE_REQUIRED' WHEN n_bad > 0 THEN 'INVALID_SOURCE_LINEAGE' WHEN n_hashes > 1 THEN 'SOURCE_HASH_MISMATCH' END AS code
    FROM part LEFT JOIN facts ON row_number = p_partkey LEFT JOIN hashes h ON h.row_number = p_partkey""",
)
def _(t: Tables) -> DataFrame:
    references = t.part.select(
        F.concat(F.lit("R"), "p_partkey").alias("reference_id"), F.col("p_partkey").alias("row_number"),
        (F.col("p_size") > 5).alias("document_retrieval_eligible"),
    )
    links = t.lineitem.select(F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").alias("row_number")).distinct()
    aside = t.part.filter("p_size <= 2").select(F.col("p_partkey").alias("row_number"))
    return trusted.rejection_codes(references, export_passages(t), links, aside, ["INTERNAL"])


@query(
    "source_documents",
    """SELECT 'S' || l_suppkey AS document_id, sha256(l_suppkey::VARCHAR) AS source_sha256, count(DISTINCT l_linenumber) AS n_pages FROM lineitem GROUP BY l_suppkey""",
)
def _(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        F.concat(F.lit("S"), "l_suppkey").alias("document_id"), F.sha2(F.col("l_suppkey").cast("string"), 256).alias("source_sha256"),
        F.col("l_linenumber").alias("page_number_1_based"),
    )
    return trusted.source_documents(rows).drop("pages")


@query(
    "first_evidence",
    """WITH e AS (SELECT DISTINCT l_orderkey AS reference_id, l_partkey AS chunk_id, l_linenumber::BIGINT AS position FROM lineitem),
    c AS (SELECT l_orderkey AS reference_id, l_partkey AS chunk_id, min(l_linenumber) AS support_order FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
    SELECT reference_id, chunk_id, position FROM e LEFT JOIN c USING (reference_id, chunk_id)
    QUALIFY row_number() OVER (PARTITION BY reference_id ORDER BY support_order NULLS LAST, position, chunk_id) = 1""",
)
def _(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_orderkey").alias("reference_id"), F.col("l_partkey").alias("chunk_id"), F.col("l_linenumber").alias("position"), "l_returnflag")
    chosen = rows.filter("l_returnflag = 'R'").groupBy("reference_id", "chunk_id").agg(F.min("position").alias("support_order"))
    return trusted.first_evidence(rows.drop("l_returnflag").distinct(), chosen).select("reference_id", "chunk_id", "position")


@query("source_fragments")
def _(t: Tables) -> DataFrame:
    parts = t.documents.select("doc_id", trusted.safe_fragments(F.col("text"), 220).alias("fragments"))
    return parts.select("doc_id", F.size("fragments").alias("n_fragments"), trusted.excerpt(F.col("fragments"), 700).alias("excerpt"))
