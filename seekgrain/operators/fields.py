"""Field-weighted lexical scoring of references."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekgrain import presets
from seekgrain.functions import text as tx
from seekgrain.functions import vocabulary as vocab
from seekgrain.operators.lexical import LENGTH_ROW, PHRASE_MARK, idf, marks, term_score, with_marks
from seekgrain.session import BROADCAST_ROWS, hint_broadcast, is_bounded, reliable_checkpoint, stored

EDGE = "[ .;:|\\-–—…]"
LEADING_EDGE = "[ .;:|\\-–—]"
#: Terms of a query whose bits stand in one whole number.
WORD_BITS = 62


def remainder(full: Column, prefix: Column) -> Column:
    """The part of ``full`` after a prefix it starts with in search form, else ``full``."""

    def rest(parts: Column) -> Column:
        cut = F.substring(full, F.length(parts["prefix"]) + 1, F.length(full))
        return (
            F.when((full == "") | (prefix == ""), "")
            .when(parts["whole"] == parts["start"], "")
            .when(F.startswith(parts["whole"], parts["start"]), tx.lstrip(cut, LEADING_EDGE))
            .otherwise(full)
        )

    trimmed = tx.rstrip(prefix, EDGE)
    return tx.bind(
        F.struct(trimmed.alias("prefix"), tx.fold(trimmed).alias("start"), tx.fold(full).alias("whole")), rest
    )


def own_fields(references: DataFrame) -> DataFrame:
    """(reference_id, field, text) of the catalog's own fields; empty fields stay as rows so that
    every field's corpus counts all references. The description field is always empty."""
    cleaned = references.select(
        "reference_id",
        "technologies",
        *[
            tx.clean(c).alias(c)
            for c in ("project_title", "mission_name", "service_nature", "offering", "sector", "client")
        ],
    )
    mission = F.col("mission_name")
    fields = {
        "title": F.col("project_title"),
        "mission_name": tx.bind(
            tx.fold(tx.rstrip("project_title", EDGE)),
            lambda t: F.when((t != "") & F.startswith(tx.fold(mission), t), "").otherwise(mission),
        ),
        "services_delivered": remainder(F.col("service_nature"), F.col("project_title")),
        "description": F.lit(""),
        "technologies": F.array_join("technologies", " "),
        "offerings": F.col("offering"),
        "sector": F.col("sector"),
        "client": F.col("client"),
    }
    references = cleaned
    return long_fields(references, "reference_id", fields)


def long_fields(df: DataFrame, key: str, fields: Mapping[str, Column]) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(n).alias("field"), t.alias("text")) for n, t in fields.items()])
    return df.select(key, F.explode(entries).alias("e")).select(key, "e.field", "e.text")


def field_tokens(fields: DataFrame, key: str) -> DataFrame:
    """(reference, field, term, tf) of texts held in one row each."""
    return (
        fields.select(key, "field", F.explode(tx.tokens("text")).alias("term"))
        .groupBy(key, "field", "term")
        .agg(F.count("*").alias("tf"))
    )


def field_phrases(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, term): the known phrases whose words stand next to each other in a text."""
    phrases = F.array(*[F.lit(p) for p, _, _ in vocab.PHRASES])
    found = rows.select(*keys, tx.tokens(text).alias("_tokens"))
    return found.select(*keys, F.explode(F.filter(phrases, lambda p: tx.has_phrase(F.col("_tokens"), p))).alias("term"))


def evidence_tokens(passages: DataFrame, links: DataFrame, key: str, text: str) -> DataFrame:
    """The evidence field of a reference is the text of all its linked passages. Term counts are
    taken per passage and summed, so no reference's text is ever joined into one value."""
    per_passage = (
        passages.select(key, F.explode(tx.tokens(text)).alias("term"))
        .groupBy(key, "term")
        .agg(F.count("*").alias("n"))
    )
    return linked_counts(per_passage, links, key)


def linked_counts(per_passage: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """(reference, field, term, tf) of ``per_passage(key, term, n)``, summed over the linked passages."""
    return (
        per_passage.join(links, key)
        .groupBy("reference_id", "term")
        .agg(F.sum("n").alias("tf"))
        .select("reference_id", F.lit("evidence").alias("field"), "term", "tf")
    )


def asked_counts(
    own: DataFrame, counted: DataFrame, links: DataFrame, query_terms: DataFrame, phrases, key: str, few: bool
) -> DataFrame:
    """(reference_id, field, term, tf) of ``own`` fields and linked passages: asked terms, one row without a term
    that carries the length of the field, and the known phrases behind a mark. All texts are read whole; only
    counts that no query asks for are not kept. ``counted`` is that of ``lexical.build_index``."""
    wanted = query_terms.select("term").distinct().unionByName(marks(own.sparkSession, phrases))
    exploded = (
        own.select("reference_id", "field", tx.tokens("text").alias("_tokens"))
        .withColumn("_length", F.size("_tokens"))
        .select("reference_id", "field", "_length", F.explode(with_marks(F.col("_tokens"), phrases)).alias("term"))
        .join(hint_broadcast(wanted, few), "term", "left_semi")
    )
    is_length = F.col("term") == LENGTH_ROW
    named = exploded.groupBy("reference_id", "field", "term").agg(
        F.sum(F.when(is_length, F.col("_length")).otherwise(1)).alias("tf")
    )
    n = F.when(is_length, F.col("doc_length") * F.col("valid_tf")).otherwise(F.col("valid_tf"))
    per_passage = counted.select(key, "term", n.alias("n")).filter("n > 0")
    return named.filter("tf > 0").unionByName(linked_counts(per_passage, links, key))


def told_apart(counts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The term counts, the phrases and the lengths of ``asked_counts``."""
    term = F.col("term")
    marked = counts.filter(F.startswith(term, F.lit(PHRASE_MARK)))
    # An own field that several rows of a reference hold names a phrase once for each.
    times = F.when(F.col("field") == "evidence", F.lit(1).cast("bigint")).otherwise(F.col("tf"))
    phrases = marked.select("reference_id", "field", F.substring(term, F.lit(2), F.length(term)).alias("term"),
                            F.explode(F.sequence(F.lit(1).cast("bigint"), times)).alias("_n")).drop("_n")
    lengths = counts.filter(term == LENGTH_ROW).select("reference_id", "field", F.col("tf").alias("length"))
    return counts.filter((term != LENGTH_ROW) & ~F.startswith(term, F.lit(PHRASE_MARK))), phrases, lengths


def score_fields(
    tokens: DataFrame,
    references: DataFrame,
    query_terms: DataFrame,
    query: str,
    key: str,
    weights: Mapping[str, float] = presets.FIELD_WEIGHTS,
    k1: float = 1.2,
    b: float = 0.75,
    few_query_terms: bool = False,
    everything: DataFrame | None = None,
    lengths: DataFrame | None = None,
) -> DataFrame:
    """(query, reference, field, raw, normalized, weighted).

    Term statistics describe ``everything``, the whole catalog with its references without any token
    (else the references in ``tokens``); only the normalisation by the best score looks at the eligible
    ``references``. Averages (one row per field), and with few query terms the best scores and the
    frequencies of the asked terms, are broadcast, so no join shuffles on a field or a broad query.
    ``lengths`` has those of the fields where ``tokens`` holds the asked terms only.
    """
    counted = tokens if everything is None else everything
    n = F.lit(counted.select(key).distinct().agg(F.count("*").alias("n")).scalar())
    if lengths is None:
        lengths = tokens.groupBy(key, "field").agg(F.sum("tf").alias("length"))
    averages = lengths.groupBy("field").agg((F.sum("length") / n).alias("average"))
    asked = hint_broadcast(query_terms.select("term").distinct(), few_query_terms)
    frequencies = tokens.join(asked, "term", "left_semi").groupBy("field", "term").agg(F.count("*").alias("df"))
    wanted = hint_broadcast(query_terms.select(query, "term").distinct(), few_query_terms)
    hits = (
        tokens.join(asked, "term", "left_semi")
        .join(references.select(key).distinct(), key, "left_semi")
        .join(lengths, [key, "field"])
        .join(F.broadcast(averages), "field")
        .join(hint_broadcast(frequencies, few_query_terms), ["field", "term"])
        .withColumn(
            "part", term_score(idf(F.col("df"), n), F.col("tf"), F.col("length"), F.col("average"), k1, b)
        )
    )
    # Stored, as the best scores and the shares of them read it: it costs a join of all hits with all queries.
    raw = stored(hits.join(wanted, "term").groupBy(query, key, "field").agg(F.round(F.sum("part"), 8).alias("raw")))
    best = raw.groupBy(query, "field").agg(F.max("raw").alias("best"))
    weight = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    normalized = F.when(F.col("best") > 0, F.col("raw") / F.col("best")).otherwise(0.0)
    return raw.join(hint_broadcast(best, few_query_terms), [query, "field"]).select(
        query,
        key,
        "field",
        "raw",
        normalized.alias("normalized"),
        (normalized * F.element_at(weight, F.col("field"))).alias("weighted"),
    )


def exact_matches(
    tokens: DataFrame,
    references: DataFrame,
    query_terms: DataFrame,
    query: str,
    key: str,
    few_query_terms: bool = False,
) -> DataFrame:
    """(query, reference, field, terms, strong_terms, bonus) of whole-token matches.

    ``query_terms`` has (query, term, category). The terms of a query are numbered, so that rows are
    gathered as bits of whole numbers, which the columns ``held0`` and on and ``strong0`` and on have too.
    """
    strong = F.col("category").isin("technology", "acronym")
    asked = query_terms.select(query, "term", "category").distinct()
    listed = asked.groupBy(F.col(query).alias("_query")).agg(F.sort_array(F.collect_set("term")).alias("_asked"))
    listed = hint_broadcast(reliable_checkpoint(listed), few_query_terms)
    same_query = F.col(query).eqNullSafe(F.col("_query"))
    n_words = -(-max(1, listed.agg(F.max(F.size("_asked"))).first()[0] or 0) // WORD_BITS)
    at = F.array_position("_asked", F.col("term")) - 1
    wanted = asked.join(listed, same_query).select(query, "term", "category", at.alias("_at"))
    multipliers = F.create_map(*[F.lit(x) for pair in presets.FIELD_BONUS_MULTIPLIERS.items() for x in pair])
    per_term = F.when(strong, presets.EXACT_PER_TERM * presets.EXACT_STRONG_MULTIPLIER).otherwise(
        presets.EXACT_PER_TERM
    )

    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("_at") % WORD_BITS).cast("int"))
    none = F.lit(0).cast("bigint")
    held = [F.when(F.floor(F.col("_at") / WORD_BITS) == i, bit).otherwise(none) for i in range(n_words)]
    found = (
        tokens.join(hint_broadcast(wanted, few_query_terms), "term")
        .join(references.select(key).distinct(), key, "left_semi")
        .groupBy(query, key, "field")
        .agg(
            F.sum(per_term).alias("points"),
            *[F.bit_or(bits).alias(f"held{i}") for i, bits in enumerate(held)],
            *[F.bit_or(F.when(strong, bits).otherwise(none)).alias(f"strong{i}") for i, bits in enumerate(held)],
        )
        .join(listed, same_query)
    )

    def named(name: str) -> Column:
        words = F.array(*[F.col(f"{name}{i}") for i in range(n_words)])

        def is_set(place: Column) -> Column:
            word = F.get(words, F.floor(place / WORD_BITS).cast("int"))
            return F.call_function("getbit", word, (place % WORD_BITS).cast("int")) == 1

        return F.filter("_asked", lambda _, place: is_set(place))

    return found.select(
        query,
        key,
        "field",
        named("held").alias("terms"),
        named("strong").alias("strong_terms"),
        (
            F.least("points", F.lit(presets.EXACT_MAXIMUM))
            * F.coalesce(F.element_at(multipliers, F.col("field")), F.lit(1.0))
        ).alias("bonus"),
        *[f"{name}{i}" for name in ("held", "strong") for i in range(n_words)],
    )


def combine(scores: DataFrame, matches: DataFrame, query: str, key: str, digits: int = 6) -> DataFrame:
    """One row per (query, reference): combined score, exact terms and matched fields."""
    names = sorted(presets.FIELD_WEIGHTS)
    words = [c for c in matches.columns if c.rstrip("0123456789") in ("held", "strong")]
    none = F.lit(0).cast("bigint")
    both = scores.select(query, key, "field", "weighted", F.lit(0.0).alias("bonus"), *[none.alias(c) for c in words],
                         F.lit(False).alias("exact")).unionByName(
        matches.select(query, key, "field", F.lit(0.0).alias("weighted"), "bonus", *words, F.lit(True).alias("exact"))
    )
    # Fields whose matches count as strong, and as capability support.
    strong_fields = ["title", "mission_name", "services_delivered", "description", "technologies", "evidence"]
    is_strong = F.col("field").isin(*strong_fields)

    summed = both.groupBy(query, key).agg(
        F.round(F.sum("weighted") + F.sum("bonus"), digits).alias("score"),
        *[F.bool_or(F.col("exact") & (F.col("field") == name)).alias(f"_in{i}") for i, name in enumerate(names)],
        *[F.bit_or(F.when(is_strong, F.col(c)).otherwise(none)).alias(c) for c in words],
        F.count_if(F.col("exact") & is_strong & (F.col("field") != "evidence")).alias("capability_field_support"),
        F.coalesce(F.bool_or(F.col("exact") & (F.col("field") == "evidence")), F.lit(False)).alias(
            "evidence_field_support"
        ),
    )

    def n_terms(name: str) -> Column:
        return sum((F.bit_count(c) for c in words if c.startswith(name)), F.lit(0))

    return summed.select(
        query,
        key,
        "score",
        F.array_compact(F.array(*[F.when(F.col(f"_in{i}"), F.lit(name)) for i, name in enumerate(names)])).alias(
            "matched_fields"
        ),
        n_terms("held").alias("strong_exact_term_count"),
        n_terms("strong").alias("technology_acronym_match_count"),
        "capability_field_support",
        "evidence_field_support",
    )


def project_to_passages(scores: DataFrame, links: DataFrame, query: str, key: str) -> DataFrame:
    """Each linked passage takes the best score of its references."""
    return (
        links.join(scores.select(query, "reference_id", "score"), "reference_id")
        .groupBy(query, key)
        .agg(F.max("score").alias("score"))
    )


def leading_references(scores: DataFrame, links: DataFrame, query: str, key: str, depth: int) -> DataFrame:
    """The ``scores`` that can place a passage among the ``depth`` best of its query, and some more.

    A reference puts forward as many passages as are linked to it, and a passage is put forward by at most
    ``most`` references. So once the references down to some score have ``depth * most`` links, they put forward
    ``depth`` passages with that score or a better one, and none below it takes their place. Links are counted
    in steps of a hundredth of the score.
    """
    most = links.groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    linked = links.groupBy("reference_id").agg(F.count("*").alias("_links"))
    linked = hint_broadcast(linked, is_bounded(linked, BROADCAST_ROWS))
    step = F.floor(F.col("score") * 100)
    rows = scores.select(query, "reference_id", "score").withColumn("_step", step).join(linked, "reference_id")
    sums = rows.groupBy(query, "_step").agg(F.sum("_links").alias("_links"))
    down = Window.partitionBy(query).orderBy(F.desc("_step"))
    last = (
        sums.withColumn("_links", F.sum("_links").over(down))
        .filter(F.col("_links") >= depth * most)
        .groupBy(query)
        .agg(F.max("_step").alias("_last"))
    )
    return rows.join(last, query, "left").filter(F.col("_last").isNull() | (F.col("_step") >= F.col("_last"))).select(
        query, "reference_id", "score"
    )


def project_to_pairs(pairs: DataFrame, scores: DataFrame, links: DataFrame, query: str, key: str) -> DataFrame:
    """``project_to_passages`` for the asked (query, passage) ``pairs`` only."""
    asked = pairs.select(query, key).distinct().join(links, key)
    return (
        asked.join(scores.select(query, "reference_id", "score"), [query, "reference_id"])
        .groupBy(query, key)
        .agg(F.max("score").alias("score"))
    )
