"""Script shares and language by function words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seekgrain.functions import text as tx
from seekgrain.functions import vocabulary as vocab

SCRIPTS = ("Arabic", "Latin", "Cyrillic", "Hebrew")
# The tatweel is a letter named Arabic although its script property is Common.
CLASSES = {
    "Arabic": r"[[\p{IsArabic}\x{640}]&&\p{L}]",
    "Latin": r"[\p{IsLatin}&&\p{L}]",
    "Cyrillic": r"[\p{IsCyrillic}&&\p{L}]",
    "Hebrew": r"[\p{IsHebrew}&&\p{L}]",
}


def letter_counts(text: Column) -> Column:
    """Letters by script of an already composed text; Latin-only text needs one count."""
    total = F.length(F.regexp_replace(text, r"\P{L}+", ""))

    def general(letters: Column) -> Column:
        counts = {name: F.length(text) - F.length(F.regexp_replace(text, CLASSES[name] + "+", "")) for name in SCRIPTS}
        return F.struct(
            *[counts[name].alias(name.lower()) for name in SCRIPTS], letters.alias("letters")
        )

    def latin(letters: Column) -> Column:
        return F.struct(
            *[(letters if name == "Latin" else F.lit(0)).alias(name.lower()) for name in SCRIPTS],
            letters.alias("letters"),
        )

    return tx.bind(
        total,
        lambda n: F.when(F.regexp_like(text, F.lit(tx.NOT_LATIN)), general(n)).otherwise(latin(n)),
    )


def hint_score(words: Column, hints: list[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*hints)))


def analyze(text: Column | str) -> Column:
    """Struct: detected_language, scripts, rtl, mixed_script, arabic_ratio, latin_ratio."""
    return tx.bind(tx.compatible(text), analyze_composed)


def analyze_composed(composed: Column) -> Column:
    return tx.bind(letter_counts(composed), lambda counts: _decide(composed, counts))


def _decide(composed: Column, counts: Column) -> Column:
    lowered = F.lower(composed)
    words = tx.words(lowered)
    french = hint_score(words, vocab.FRENCH_HINTS) + F.when(
        F.regexp_like(lowered, F.lit(vocab.FRENCH_ACCENTS)), 2
    ).otherwise(0)
    english = hint_score(words, vocab.ENGLISH_HINTS)
    arabic = tx.ratio(counts["arabic"], counts["letters"])
    latin = tx.ratio(counts["latin"], counts["letters"])
    mixed = (counts["arabic"] > 0) & (counts["latin"] > 0)
    other = counts["letters"] - sum((counts[name.lower()] for name in SCRIPTS), F.lit(0))
    ordered = F.array_sort(
        F.filter(
            F.array(
                *[
                    F.struct((-n).alias("n"), F.lit(name).alias("script"))
                    for name, n in [*((s, counts[s.lower()]) for s in SCRIPTS), ("Other", other)]
                ]
            ),
            lambda s: s["n"] < 0,
        )
    )
    detected = (
        F.when(mixed, "mixed")
        .when(arabic >= 0.5, "ar")
        .when(latin >= 0.4, F.when(french > english, "fr").otherwise("en"))
        .otherwise("und")
    )
    return F.struct(
        detected.alias("detected_language"),
        F.transform(ordered, lambda s: s["script"]).alias("scripts"),
        ((arabic > latin) & (arabic >= 0.5)).alias("rtl"),
        mixed.alias("mixed_script"),
        F.round(arabic, 4).alias("arabic_ratio"),
        F.round(latin, 4).alias("latin_ratio"),
    )


# Function words that tell French prose from English prose.
FRENCH_FUNCTION_WORDS = (
    "au aux avec ce ces cette dans de des du elle en est et la le les leur mission notre pour qui référence sur une"
).split()
ENGLISH_FUNCTION_WORDS = "a an and are as at by for from in is of on our that the their this to with".split()
PROSE_WORD = "[a-zà-öø-ÿ']+"


def target_check(text: Column | str, target: str) -> Column:
    """PASS, CLEAR_MISMATCH or UNCERTAIN for prose that should be in ``target`` (fr, en or ar)."""
    return tx.bind(tx.compatible(text), lambda composed: _target_status(composed, target))


def _target_status(composed: Column, target: str) -> Column:
    arabic = F.length(composed) - F.length(F.regexp_replace(composed, r"[\x{600}-\x{6ff}&&\p{L}]+", ""))

    def by_counts(c: Column) -> Column:
        share = c["arabic"] / F.greatest(c["arabic"] + c["latin"], F.lit(1))
        if target == "ar":
            return (
                F.when((c["arabic"] >= 20) & (share >= 0.60), "PASS")
                .when((c["latin"] >= 40) & (share < 0.20), "CLEAR_MISMATCH")
                .otherwise("UNCERTAIN")
            )
        wanted, other = ("french", "english") if target == "fr" else ("english", "french")
        total = c["french"] + c["english"]
        ratio = c[wanted] / F.greatest(total, F.lit(1))
        return (
            F.when((c["arabic"] >= 20) & (share >= 0.60), "CLEAR_MISMATCH")
            .when(c["foreign_sentence"] | ((c[other] >= 4) & (total >= 6) & (ratio < 0.40)), "CLEAR_MISMATCH")
            .when((total >= 3) & (ratio >= 0.60) & (share < 0.20), "PASS")
            .otherwise("UNCERTAIN")
        )

    lowered = F.lower(composed)

    def scored(words: Column) -> Column:
        return F.struct(
            F.size(words).alias("n"),
            hint_score(words, FRENCH_FUNCTION_WORDS).alias("fr"),
            hint_score(words, ENGLISH_FUNCTION_WORDS).alias("en"),
        )

    def prose(part: Column) -> Column:
        return F.regexp_extract_all(part, F.lit(PROSE_WORD), F.lit(0))

    sentences = F.transform(F.split(lowered, r"[.!?;:\n]+"), lambda part: tx.bind(prose(part), scored))
    foreign = "en" if target == "fr" else "fr"

    def is_foreign(s: Column) -> Column:
        return (s["n"] >= 7) & (s[foreign] >= 3) & (s[foreign] / F.greatest(s["fr"] + s["en"], F.lit(1)) >= 0.70)

    def summed(parts: Column) -> Column:
        def total(name: str) -> Column:
            return F.aggregate(F.transform(parts, lambda s: s[name]), F.lit(0), lambda a, x: a + x)

        return F.struct(
            arabic.alias("arabic"),
            letter_counts(composed)["latin"].alias("latin"),
            total("fr").alias("french"),
            total("en").alias("english"),
            F.exists(parts, is_foreign).alias("foreign_sentence"),
        )

    return tx.bind(tx.bind(sentences, summed), by_counts)
