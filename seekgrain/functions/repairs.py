"""Repairs of written text: echoes, cut-off ends, foreign letters, persons, phase labels, guessed expansions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from seekgrain.functions import text as tx

# Words that do not end a text, wording that names a person, a phase label, words of
# its tests, words before a spelled-out acronym, capitals that are no acronym, and lengths.
DANGLING = (
    r"ainsi\s+que", "de", "du", "des", "d['’]", "la", "le", "les", "et", "ou", "avec", "pour", "sur", "en",
    "and", "or", "of", "to", "for", "with", "on", "in", r"as\s+well\s+as",
)
TITLE = r"(?:M\.|Mme|Mlle|Mr|Mrs|Ms|Dr|Pr)"
PERSONS = (
    rf"\s+par\s+(?:un|une)\s+[^.;()]{{0,60}}\({TITLE}\s+[^)]{{1,80}}\)",
    rf"\s*\({TITLE}\s+[^)]{{1,80}}\)",
    rf"\bpar\s+{TITLE}\s+[^,.;()]+(?:,\s*[^.;()]*)?",
)
PHASE_LABEL = r"\((?:phase|étape)\s*\d*\s*:\s*test\w*\)"
PHASE_WORDS = r"\b(?:test|essai|exercice)\w*\b"
SPELLED = r"\b((?:formalisation|élaboration|définition|préparation)\s+(?:du|de\s+la|des|d['’])\s+)[^.;()]{3,100}?\s*\("
ACRONYM, NO_ACRONYMS = r"\b[A-ZÀ-ÖØ-Þ]{2,6}\b", ("ETAPE", "PHASE")
ECHO_WORDS, ECHO_LEAST = 5, 5

EDGE = r"[ ,;:\-]"
FOREIGN = r"[\p{L}&&[^\p{IsLatin}]]"


def _single_spaced(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s{2,}", " ")


def _punctuated(text: Column) -> Column:
    """No space before a mark, no double space, no mark at either end."""
    return tx.strip(_single_spaced(F.regexp_replace(text, r"(?U)\s+([.,;])", "$1")), EDGE)


def without_echo(text: Column | str) -> Column:
    """Without the last one to five words where they repeat the first ones; the longest such end goes.

    Words are compared by their Latin letters and digits, so words without any are equal to one another.
    Texts of fewer than five words stay; white space is squeezed. Null gives null.
    """

    def plain(words: Column) -> Column:
        return F.transform(words, lambda w: F.regexp_replace(tx.fold(w), "[^a-z0-9]", ""))

    def cut(words: Column, size: Column) -> Column:
        kept = F.array_join(F.slice(words, F.lit(1), F.size(words) - size), " ")
        return F.when(size == 0, kept).otherwise(tx.rstrip(kept, EDGE))

    def repaired(words: Column) -> Column:
        ends = F.struct(
            plain(F.slice(words, 1, ECHO_WORDS)).alias("head"),
            plain(F.slice(words, F.greatest(F.size(words) - ECHO_WORDS, F.lit(0)) + 1, F.lit(ECHO_WORDS))).alias("tail"),
        )
        size = tx.bind(
            ends,
            lambda e: F.coalesce(
                *[
                    F.when(
                        (F.size(words) >= max(ECHO_LEAST, 2 * n)) & (F.slice(e["head"], 1, n) == F.slice(e["tail"], -n, n)), n
                    )
                    for n in range(ECHO_WORDS, 0, -1)
                ],
                F.lit(0),
            ),
        )
        return tx.bind(size, lambda n: cut(words, n))

    return tx.bind(F.split(tx.squeeze(text), " "), repaired)


def without_dangling_end(text: Column | str, words: Sequence[str] = DANGLING) -> Column:
    """Without the connectors (patterns) that a cut-off text ends with, however many; null gives null."""
    tail = rf"(?iU)(?:\s|^)(?:(?<=\s|^)(?:{'|'.join(words)})(?=\s|{EDGE}|$)\s*+{EDGE}*+\s?+)++$"

    def repaired(value: Column) -> Column:
        return F.when(
            F.regexp_like(value, F.lit(tail)), tx.rstrip(F.regexp_replace(value, tail, ""), EDGE)
        ).otherwise(value)

    return tx.bind(tx.strip(text), repaired)


def without_foreign_letters(text: Column | str, language: Column | str) -> Column:
    """French text with letters of other scripts taken out; other languages are only stripped."""
    value = tx._col(text)
    latin = tx.strip(tx.rstrip(_single_spaced(F.regexp_replace(value, FOREIGN, " ")), EDGE))
    return F.when(F.coalesce(tx._col(language) == "fr", F.lit(False)), latin).otherwise(tx.strip(value))


def without_persons(text: Column | str) -> Column:
    """Without the persons that a text names as authors; null gives null."""
    value = tx._col(text)
    for pattern in PERSONS:
        value = F.regexp_replace(value, f"(?iU){pattern}", "")
    return _punctuated(value)


def without_orphan_phase(text: Column | str) -> Column:
    """Without a label of a test phase where nothing else in the text is about tests; null gives null."""

    def repaired(value: Column) -> Column:
        rest = F.regexp_replace(value, f"(?iU){PHASE_LABEL}", " ")
        orphan = F.regexp_like(value, F.lit(f"(?iU){PHASE_LABEL}")) & ~F.regexp_like(rest, F.lit(f"(?iU){PHASE_WORDS}"))
        several = F.regexp_count(value, F.lit(f"(?iU){PHASE_LABEL}")) > 1  # then each label is about the other's tests
        return _punctuated(F.when(orphan & ~several, rest).otherwise(value))

    return tx.bind(tx._col(text), repaired)


def without_guessed_expansions(text: Column | str, scope: Column | str) -> Column:
    """Acronyms of the trusted ``scope`` without spelled-out forms next to them; null scope trusts none."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(tx._col(scope), F.lit("")), F.lit(f"(?U){ACRONYM}"), F.lit(0)))

    def step(kept: Column, acronym: Column) -> Column:
        bare = F.regexp_replace(kept, F.concat(F.lit(r"(?U)\b"), acronym, F.lit(r"\s*\([^)]{3,100}\)")), acronym)
        spelled = F.concat(F.lit(f"(?iU){SPELLED}"), acronym, F.lit(r"\)"))
        return F.regexp_replace(bare, spelled, F.concat(F.lit("$1"), acronym))

    trusted = F.filter(found, lambda a: ~a.isin(*NO_ACRONYMS))
    return tx.strip(_single_spaced(F.aggregate(trusted, tx._col(text), step)))
