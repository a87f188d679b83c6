"""How far written texts rest on the trusted texts of their reference: unknown words, anchors, derived value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekgrain.functions import text as tx
from seekgrain.session import is_bounded

# Words that a rewrite may add, inferences that no source supports, openings that a
# source must name, words that anchor nothing, openings of a derived value per language, wording of
# measured results, and lengths and shares of the rules.
REWRITE_WORDS = (
    "besoin necessite difficulte enjeu amelioration renforcement structuration clarification securisation visibilite "
    "meilleure capacite permettre assurer dispose disposer operationnel operationnelle organisationnel "
    "organisationnelle resilience coherence coherent coherente pilotage piloter elaboration elaborer formalisation "
    "formaliser preparation preparer realisation realiser gestion gerer definition definir accompagnement accompagner "
    "appui mise place maintien concrete adaptation adoption efficace efficacite dispositif demarche cadre activite "
    "activites mission travaux equipes projet projets leurs cette ainsi entre faire grace meilleur avancement "
    "interruption interruptions resultat resultats role roles responsabilite responsabilites"
).split()
UNSUPPORTED = (
    r"\badapt\w*\s+(?:aux?|a\s+la)\s+specific",
    r"\bcontexte\s+(?:local|national|bancaire)",
    r"\bentre\s+(?:les\s+)?(?:departements|directions|equipes)",
)
LACKS = ("absence", "difficulte", "limite")
NO_ANCHORS = (
    "about after avec client dans from mission pour project projet reference that their this through using with work "
    "the and des les une sur par المشروع العميل هذه التي على إلى في من مع"
).split()
VALUE_OPENINGS = {
    "fr": r"renforcement|structuration|amélioration(?:\s+de\s+la\s+visibilité)?|clarification|sécurisation|"
    r"mise\s+à\s+disposition|meilleure\s+capacité|meilleure\s+préparation|consolidation",
    "en": r"strengthening|structuring|improved\s+visibility|greater\s+visibility|clarification|securing|availability|"
    r"improved\s+ability|greater\s+ability|better\s+preparedness|enhanced\s+preparedness|consolidation",
    "ar": r"تعزيز|هيكلة|تحسين\s+الرؤية|توضيح|تأمين|إتاحة|قدرة\s+أفضل|تحسين\s+القدرة|رفع\s+الجاهزية|ترسيخ",
}
MEASURED = (
    r"\b(?:roi|return\s+on\s+investment|retour\s+sur\s+investissement|savings?|économies?|gains?\s+financiers?|revenue|"
    r"profit|award|prix|trophée|certification|certifié|compliance|conformité|faster|duration\s+reduction)\b|%|"
    r"العائد\s+على\s+الاستثمار|وفورات|أرباح|جائزة|شهادة"
)
UNKNOWN_WORDS, UNKNOWN_SHARE, SHORTEST_STEM = 2, 0.20, 5

#: Longest beginning of a word that is looked up; longer words also meet by their beginning of this length and are compared.
LONGEST_STEM = 40
#: Slices of the texts of one reference, so that a frequent word of a frequent reference is not one task.
SLICES = 8
#: References up to which their keys are broadcast, so that only trusted texts of asked references are split into words.
ASKED_KEYS = 1_000_000


def telling_words(text: Column) -> Column:
    """Distinct folded words of four or more Latin letters and digits."""
    return F.array_distinct(F.regexp_extract_all(tx.fold(text), F.lit("[a-z0-9]{4,}"), F.lit(0)))


def anchor_words(text: Column, dropped: Sequence[str] = NO_ANCHORS) -> Column:
    """Distinct folded words of two or more characters that are no number and not ``dropped``, compared folded."""
    found = F.array_distinct(F.regexp_extract_all(tx.fold(text), F.lit(r"[\p{L}\p{N}]{2,}"), F.lit(0)))
    folded = F.transform(F.array(*[F.lit(w) for w in dropped]), tx.fold) if dropped else F.array().cast("array<string>")
    return F.filter(F.array_except(found, folded), lambda w: ~F.regexp_like(w, F.lit(r"(?U)^\d+$")))


def _dealt(found: DataFrame) -> DataFrame:
    """Every row once per slice."""
    return found.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))


def _asked(texts: DataFrame, ids: Sequence[str], key: str, words: Column) -> DataFrame:
    """(ids, key, word, slice) of the distinct words of every text."""
    rows = texts.select(*ids, F.col(key).alias("key"), F.explode(words).alias("word"))
    return rows.withColumn("slice", F.pmod(F.xxhash64(*ids), F.lit(SLICES)).cast("int"))


def _about(texts: DataFrame, trusted: DataFrame, key: str) -> DataFrame:
    """The trusted texts of references that ``texts`` name, where the names fit a broadcast; else all."""
    named = texts.select(F.col(key).alias("key")).filter("key IS NOT NULL").distinct()
    keyed = trusted.withColumnRenamed(key, "key")
    return keyed.join(F.broadcast(named), "key", "left_semi") if is_bounded(named, ASKED_KEYS) else keyed


def _pairs(asked: DataFrame) -> DataFrame:
    """Every (key, word) once, so that no pair is more than one row, however many texts hold it."""
    return asked.select("key", "word").filter("key IS NOT NULL").distinct()


def _held(trusted: DataFrame, words: Column) -> DataFrame:
    return _pairs(trusted.select("key", F.explode(words).alias("word")))


def entailment(
    texts: DataFrame, ids: Sequence[str], text: str, trusted: DataFrame, key: str, trusted_text: str,
    allowed: Sequence[str] = REWRITE_WORDS, applies: Column | None = None,
) -> DataFrame:
    """(ids, n_words, n_unknown, entailed) of every row of ``texts``, held against the ``trusted`` texts with its ``key``.

    A word is unknown that no trusted text has and no rewrite may add. A text is entailed with fewer than two
    unknown words or at most a fifth of all, unless it infers what no source supports or opens with a lack
    that no trusted text names. Where ``applies`` (a condition on ``texts``) does not hold, a text is entailed.
    Null texts have no words; without trusted texts all words are unknown. Ids are expected once; rows with
    a null id have counts of zero.
    """
    asked = _asked(texts, ids, key, telling_words(F.col(text)))
    about = _about(texts, trusted, key)
    held = _held(about, telling_words(F.col(trusted_text)))
    known = _pairs(asked).join(held, ["key", "word"], "left_semi").withColumn("known", F.lit(True))
    met = asked.join(_dealt(known), ["key", "word", "slice"], "left")
    unknown = F.col("known").isNull() & ~F.col("word").isin(*allowed) if allowed else F.col("known").isNull()
    counts = met.groupBy(*ids).agg(F.count("*").alias("n_words"), F.count_if(unknown).alias("n_unknown"))

    lack = "|".join(LACKS)
    names = about.select("key", F.regexp_like(tx.fold(trusted_text), F.lit(rf"\b(?:{lack})\b")).alias("named"))
    names = names.groupBy("key").agg(F.max("named").alias("named")).filter("named")
    folded = tx.fold(text)
    flags = texts.select(
        *ids, F.col(key).alias("key"),
        (F.lit(True) if applies is None else F.coalesce(applies, F.lit(False))).alias("applies"),
        F.regexp_like(folded, F.lit("|".join(UNSUPPORTED))).alias("inferred"),
        F.regexp_like(folded, F.lit(rf"^(?:{lack})\b")).alias("lacks"),
    )
    lacking = flags.filter("lacks").join(names, "key").select(*ids, "named")
    rows = flags.join(counts, list(ids), "left").join(lacking, list(ids), "left")
    n, missing = F.coalesce("n_words", F.lit(0)), F.coalesce("n_unknown", F.lit(0))
    few = (missing < UNKNOWN_WORDS) | (missing / F.greatest(n, F.lit(1)) <= UNKNOWN_SHARE)
    sound = few & ~F.col("inferred") & (~F.col("lacks") | F.col("named").isNotNull())
    return rows.select(*ids, n.alias("n_words"), missing.alias("n_unknown"), (~F.col("applies") | sound).alias("entailed"))


def _stems(word: Column) -> Column:
    """The word itself, marked as whole, and its shorter beginnings of ``SHORTEST_STEM`` to ``LONGEST_STEM`` characters."""
    size = F.length(word)
    ends = F.sequence(F.lit(SHORTEST_STEM), F.least(size - 1, F.lit(LONGEST_STEM)))
    beginnings = F.transform(ends, lambda n: F.struct(F.left(word, n).alias("stem"), F.lit(False).alias("whole")))
    itself = F.array(F.struct(word.alias("stem"), F.lit(True).alias("whole")))
    return F.when(size <= SHORTEST_STEM, itself).otherwise(F.concat(itself, beginnings))


def anchored(
    texts: DataFrame, ids: Sequence[str], text: str, trusted: DataFrame, key: str, trusted_text: str,
    dropped: Sequence[str] = NO_ANCHORS,
) -> DataFrame:
    """(ids, anchored): whether a word of a text is a word of a trusted text with its ``key``, or one begins the other.

    Beginnings count from five characters on. In the order of words, those that begin with a word follow it
    at once, so each asked word and each of its beginnings is held against the next trusted word only, among
    words of a key with the same five characters; no two words are compared but those of more than 40
    characters with the same beginning. Null texts, keys and ids are not anchored.
    """
    asked = _asked(texts, ids, key, anchor_words(F.col(text), dropped))
    wanted = _pairs(asked)
    held = _held(_about(texts, trusted, key), anchor_words(F.col(trusted_text), dropped))

    mine = wanted.select("key", "word", F.inline(_stems(F.col("word"))))
    theirs = held.select("key", F.lit(None).cast("string").alias("word"), F.col("word").alias("stem"), F.lit(None).cast("boolean").alias("whole"))
    start = F.left("stem", F.lit(SHORTEST_STEM))
    order = Window.partitionBy("key", start).orderBy(F.desc("stem"), F.col("word").asc_nulls_first())
    trusted_word = F.when(F.col("word").isNull(), F.col("stem"))
    placed = mine.unionByName(theirs).withColumn(
        "next", F.last(trusted_word, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    begins = F.col("whole") & (F.length("stem") >= SHORTEST_STEM) & F.col("next").startswith(F.col("stem"))
    hits = placed.filter(F.col("word").isNotNull() & ((F.col("next") == F.col("stem")) | begins)).select("key", "word")

    long = F.length("word") > LONGEST_STEM
    begin = F.left("word", F.lit(LONGEST_STEM)).alias("stem")
    others = held.filter(long).select("key", begin, F.col("word").alias("other"))
    both = wanted.filter(long).select("key", "word", begin).join(others, ["key", "stem"])
    long_hits = both.filter(F.col("word").startswith(F.col("other"))).select("key", "word")

    met = asked.join(_dealt(hits.union(long_hits).distinct()), ["key", "word", "slice"], "left_semi")
    found = met.select(*ids).distinct().withColumn("anchored", F.lit(True))
    rows = texts.select(*ids).join(found, list(ids), "left")
    return rows.withColumn("anchored", F.coalesce("anchored", F.lit(False)))


def tells_value(text: Column | str, language: Column | str, openings: dict[str, str] = VALUE_OPENINGS) -> Column:
    """Whether a text opens as a derived operational value of its language and claims no measured or outside result.

    With ``anchored`` that makes a conservative derived benefit. Null texts and other languages do not.
    """
    opens = F.lit(False)
    for name, pattern in openings.items():
        opens = opens | ((tx._col(language) == name) & F.regexp_like(tx._col(text), F.lit(rf"(?iU)^\s*(?:{pattern})\b")))
    return F.coalesce(opens & ~F.regexp_like(tx._col(text), F.lit(f"(?iU)(?:{MEASURED})")), F.lit(False))
