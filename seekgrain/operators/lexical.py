"""BM25: corpus statistics, query-term analysis and scoring."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekgrain.functions import text as tx
from seekgrain.functions import vocabulary as vocab
from seekgrain.presets import TermSettings
from seekgrain.session import BROADCAST_ROWS, is_bounded, reliable_checkpoint, stored

POSTING_SALTS = 32
#: Documents whose postings one task scores.
TASK_DOCUMENTS = 20_000
LENGTH_ROW = ""
#: Set before a phrase that stands among terms; no term holds it.
PHRASE_MARK = "\x01"


@dataclass(frozen=True)
class LexicalIndex:
    """postings(doc, term, tf, doc_length), doc_stats(doc, doc_length) and one row of totals."""

    postings: DataFrame
    totals: DataFrame
    key: str
    few_query_terms: bool = False
    #: With ``valid``: (doc, doc_length, term, tf, valid_tf) with the length row of each document and its phrases.
    counted: DataFrame | None = None

    def terms(self) -> DataFrame:
        counts = self.postings.groupBy("term").agg(F.sum(F.when(F.col("tf") > 0, 1)).alias("df"))
        n = F.lit(self.totals.select("n_docs").scalar())
        return counts.select(
            "term",
            "df",
            idf(F.col("df"), n).alias("idf"),
            (F.col("df") / F.greatest(n, F.lit(1))).alias("df_ratio"),
        )


def idf(df: Column, n_docs: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def term_score(weight: Column, tf: Column, length: Column, average: Column, k1: float, b: float) -> Column:
    norm = 1 - b + b * length / F.greatest(average, F.lit(1e-9))
    return weight * tf * (k1 + 1) / (tf + k1 * norm)


def token_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, tokens, doc_length): the only place where passage text is tokenised."""
    return docs.select(key, tx.tokens(text).alias("tokens")).withColumn("doc_length", F.size("tokens"))


def totals_of(tokens: DataFrame) -> DataFrame:
    return tokens.agg(
        F.count("*").alias("n_docs"), F.avg("doc_length").alias("average_length")
    )


def with_marks(tokens: Column, phrases: Sequence[str] = ()) -> Column:
    """Tokens, the length row and, behind a mark, those of ``phrases`` that stand in them."""
    entries = F.array_append(tokens, F.lit(LENGTH_ROW))
    if not phrases:
        return entries
    held = F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: tx.has_phrase(tokens, p))
    return F.concat(entries, F.transform(held, lambda p: F.concat(F.lit(PHRASE_MARK), p)))


def marks(spark, phrases: Sequence[str] = ()) -> DataFrame:
    """(term) of what ``with_marks`` adds."""
    return spark.createDataFrame([(LENGTH_ROW,), *[(PHRASE_MARK + p,) for p in phrases]], "term string")


def build_index(
    docs: DataFrame,
    key: str,
    text: str,
    query_terms: DataFrame | None = None,
    valid: Column | None = None,
    phrases: Sequence[str] = (),
) -> LexicalIndex:
    """Index a corpus. With ``query_terms(term)`` only their postings are kept; the totals and
    the document frequencies still describe the whole corpus.

    A query-time index reads and tokenises the corpus once: each document also emits one row
    without a term that carries its length, and the reduced table is checkpointed for the
    statistics, the analysis and the scores that follow. With ``valid`` it also tells how much of a
    count is from valid documents, and ``counted`` names the ``phrases`` that stand in them.
    """
    tokens = token_table(docs, key, text)
    if query_terms is None:
        exploded = tokens.select(key, "doc_length", F.explode("tokens").alias("term"))
        postings = exploded.groupBy(key, "doc_length", "term").agg(F.count("*").alias("tf"))
        return LexicalIndex(postings, totals_of(tokens), key)
    few = is_bounded(query_terms, BROADCAST_ROWS)
    wanted = query_terms.select("term").distinct().unionByName(marks(docs.sparkSession, phrases))
    counts = [F.count("*").alias("tf")]
    if valid is not None:
        tokens = docs.select(key, tx.tokens(text).alias("tokens"), valid.alias("_valid"))
        tokens = tokens.withColumn("doc_length", F.size("tokens"))
        counts.append(F.count_if("_valid").alias("valid_tf"))
    exploded = tokens.select(
        *[c for c in tokens.columns if c != "tokens"], F.explode(with_marks(F.col("tokens"), phrases)).alias("term")
    ).join(F.broadcast(wanted) if few else wanted, "term", "left_semi")
    counted = stored(exploded.groupBy(key, "doc_length", "term").agg(*counts))
    postings = counted.filter((F.col("term") != LENGTH_ROW) & ~F.startswith("term", F.lit(PHRASE_MARK)))
    return LexicalIndex(
        postings.select(key, "doc_length", "term", "tf"),
        totals_of(counted.filter(F.col("term") == LENGTH_ROW)),
        key,
        few,
        counted if valid is not None else None,
    )


def asked_postings(index: LexicalIndex, query_terms: DataFrame) -> LexicalIndex:
    """A stored index cut down to the postings of ``query_terms(term)``; nothing of the corpus is read.

    Postings are stored in term order, so other row groups are skipped, and every posting of an asked
    term is there, so document frequencies still describe the whole corpus.
    """
    few = is_bounded(query_terms, BROADCAST_ROWS)
    wanted = query_terms.select("term").distinct()
    kept = index.postings.join(F.broadcast(wanted) if few else wanted, "term", "left_semi")
    return replace(index, postings=reliable_checkpoint(kept), few_query_terms=few)


def query_tokens(queries: DataFrame, query: str, text: str) -> DataFrame:
    """(query, position, raw, term): one row per distinct folded token, first position kept."""
    composed = tx.compatible(text)
    raw = queries.select(query, F.posexplode(tx.words(composed)).alias("position", "raw"))
    folded = raw.withColumn("parts", tx.tokens("raw")).filter(F.size("parts") == 1)
    return (
        folded.withColumn("term", F.get("parts", F.lit(0)))
        .groupBy(query, "term")
        .agg(F.min(F.struct("position", "raw")).alias("first"))
        .select(query, "term", F.col("first.position").alias("position"), F.col("first.raw").alias("raw"))
    )


def _stopword(term: Column) -> Column:
    rest = F.substring(term, F.lit(2), F.length(term))
    prefixed = F.substring(term, 1, 1).isin(*vocab.ARABIC_PREFIXES) & (F.length(term) > 2)
    return F.when(term.isin(*vocab.STOPWORDS), term).when(
        prefixed & rest.isin(*vocab.STOPWORDS), rest
    )


def analyze_terms(tokens: DataFrame, terms: DataFrame, query: str, settings: TermSettings) -> DataFrame:
    """Status and category of every query token: stopword, unknown, common or meaningful."""
    joined = tokens.join(terms, "term", "left").withColumn("stopword", _stopword(F.col("term")))
    status = (
        F.when(F.col("stopword").isNotNull(), "stopword")
        .when(F.col("df").isNull(), "unknown")
        .when(
            (F.col("idf") < settings.minimum_idf) | (F.col("df_ratio") > settings.maximum_df_ratio),
            "common",
        )
        .otherwise("meaningful")
    )
    category = (
        F.when(F.col("term").isin(*vocab.ACRONYMS), "acronym")
        .when(F.col("term").isin(*vocab.TECHNOLOGY_WORDS), "technology")
        .otherwise("term")
    )
    return joined.select(
        query,
        "position",
        "term",
        F.coalesce("stopword", "term").alias("shown_term"),
        F.when(category == "acronym", F.upper("term")).otherwise(F.col("raw")).alias("display"),
        status.alias("status"),
        category.alias("category"),
        "idf",
        "df",
        "df_ratio",
    )


def phrase_terms(analyzed: DataFrame, queries: DataFrame, query: str, text: str) -> DataFrame:
    """Known phrases of a query whose words all stayed meaningful."""
    wanted = F.array(
        *[
            F.struct(F.lit(p).alias("term"), F.lit(d).alias("display"), F.lit(c).alias("category"))
            for p, d, c in vocab.PHRASES
        ]
    )
    present = queries.select(query, tx.tokens(text).alias("tokens")).select(
        query, F.explode(F.filter(wanted, lambda p: tx.has_phrase(F.col("tokens"), p["term"]))).alias("p")
    )
    parts = present.select(
        query, "p", F.explode(F.split("p.term", " ")).alias("part"), F.size(F.split("p.term", " ")).alias("width")
    )
    kept = analyzed.filter("status = 'meaningful'").select(
        query, F.col("term").alias("part"), "idf", "df", "df_ratio"
    )
    return (
        parts.join(kept, [query, "part"])
        .groupBy(query, "p", "width")
        .agg(
            F.count("*").alias("n"),
            F.min("idf").alias("idf"),
            F.max("df").alias("df"),
            F.max("df_ratio").alias("df_ratio"),
        )
        .filter("n = width")
        .select(query, "p.term", "p.display", "p.category", "idf", "df", "df_ratio")
    )


def _padded(token_array: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(token_array, " "), F.lit(" "))


def _any_phrase(padded: Column, phrases) -> Column:
    test = F.lit(False)
    for phrase in phrases:
        test = test | F.contains(padded, F.lit(f" {phrase} "))
    return test


def concepts(token_array: Column, table: Mapping[str, Sequence[str]] = vocab.QUERY_CONCEPTS) -> Column:
    """Concepts of ``table`` (name to phrases) that the tokens name; capability concepts unless given."""
    return tx.bind(
        _padded(token_array),
        lambda padded: F.array_compact(
            F.array(
                *[F.when(_any_phrase(padded, p), F.lit(name)) for name, p in table.items()]
            )
        ),
    )


def supports_concepts(concept_names: Column, token_array: Column) -> Column:
    """Every concept has one of its evidence phrases among the tokens; true without concepts."""

    def test(padded: Column) -> Column:
        held = F.lit(True)
        for name, phrases in vocab.CONCEPT_EVIDENCE.items():
            held = held & (~F.array_contains(concept_names, name) | _any_phrase(padded, phrases))
        return held

    return F.when(F.size(concept_names) == 0, F.lit(True)).otherwise(tx.bind(_padded(token_array), test))


def supported_concepts(token_array: Column) -> Column:
    """The concepts that have one of their evidence phrases among the tokens."""
    return concepts(token_array, vocab.CONCEPT_EVIDENCE)


def all_supported(concept_names: Column, supported: Column) -> Column:
    """``supports_concepts`` of tokens whose ``supported_concepts`` are known, for many rows with the same tokens."""
    ruled = F.array(*[F.lit(name) for name in vocab.CONCEPT_EVIDENCE])
    return F.size(F.array_except(F.array_intersect(concept_names, ruled), supported)) == 0


def score(
    index: LexicalIndex,
    query_terms: DataFrame,
    query: str,
    k1: float = 1.2,
    b: float = 0.75,
    digits: int = 6,
) -> DataFrame:
    """Sum of term scores per (query, document) with at least one query term.

    ``query_terms`` has (query, term) and may hold repeats, which multiply a term's part. With few terms the
    asked postings are dealt out by document, so that scores are summed where the postings are and need no
    shuffle; parts grow in number, not in size. With many, postings of a frequent term are spread over slices,
    so its part of the join is never one task.
    """
    per_query = query_terms.groupBy(query, "term").agg(F.count("*").alias("query_tf"))
    weights = index.terms().join(per_query, "term").select(query, "term", "idf", "query_tf")
    if index.few_query_terms:
        asked = index.postings.join(F.broadcast(query_terms.select("term").distinct()), "term", "left_semi")
        n_docs = index.totals.select("n_docs").first()["n_docs"] or 0
        parts = max(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_docs // TASK_DOCUMENTS))
        matched = asked.repartition(parts, index.key).join(F.broadcast(weights), "term")
    else:
        slices = F.sequence(F.lit(0), F.lit(POSTING_SALTS - 1))
        spread = index.postings.withColumn(
            "_slice", F.pmod(F.xxhash64(index.key), F.lit(POSTING_SALTS)).cast("int")
        )
        matched = spread.join(weights.withColumn("_slice", F.explode(slices)), ["term", "_slice"])
    part = term_score(
        F.col("idf"),
        F.col("tf"),
        F.col("doc_length"),
        F.lit(index.totals.select("average_length").scalar()),
        k1,
        b,
    )
    return matched.groupBy(query, index.key).agg(
        F.round(F.sum(part * F.col("query_tf")), digits).alias("score")
    )
