"""Search folding, tokens and small string operators as native Spark expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from seekgrain.functions import unicode_rules as rules

SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
#: The characters of ``SPACE``, for a trim that looks at the ends of a text only.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c in "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85" or unicodedata.category(c)[0] == "Z")
WORD = r"[\p{L}\p{N}]+"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

# Words that stand for a missing value.
NULL_WORDS = ("", "nan", "none", "null", "#value!", "n/a", "na")


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


# The character tables are large, so the functions that use them are written as SQL lambdas: the
# text is built once and each use adds a handful of nodes on the Python side.
def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _pattern(java_regex: str) -> str:
    return f"r'{java_regex}'"


def _replace_pairs(text: str, pairs: tuple[tuple[str, str], ...]) -> str:
    """SQL that applies every literal replacement in order; the pair list is one constant."""
    table = _quoted("\u0001".join(a + "\u0002" + b for a, b in pairs))
    return (
        f"aggregate(split({table}, '\u0001'), {text}, (acc, pair) -> replace(acc, "
        "substring_index(pair, '\u0002', 1), substring_index(pair, '\u0002', -1)))"
    )


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _if_found(text: str, java_class: str, then: str, otherwise: str) -> str:
    return f"CASE WHEN regexp_like({text}, {_pattern(java_class)}) THEN {then} ELSE {otherwise} END"


def _hangul_parts(text: str) -> str:
    def unit(code: str) -> str:
        return f"decode(unhex(lpad(hex({code}), 4, '0')), 'UTF-16BE')"

    low, high = (chr(code) for code in rules.HANGUL)
    parts = (
        f"concat({unit('4352 + i DIV 588')}, {unit('4449 + (i % 588) DIV 28')}, "
        f"CASE WHEN i % 28 > 0 THEN {unit('4519 + i % 28')} ELSE '' END)"
    )
    one = _let("i", f"ascii(c) - {rules.HANGUL[0]}", parts)
    return f"array_join(transform(split({text}, ''), c -> CASE WHEN c BETWEEN '{low}' AND '{high}' THEN {one} ELSE c END), '')"


def _apply(lambda_sql: str, text: Column) -> Column:
    return F.element_at(F.call_function("transform", F.array(text), F.expr(lambda_sql)), 1)


def is_ascii(text: Column | str) -> Column:
    return F.length(_col(text)) == F.octet_length(_col(text))


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


# Latin letters, marks apart, and general punctuation: what most European text is made of.
LATIN_ONLY = (range(0x250), range(0x2010, 0x2028))
NOT_LATIN = r"[^\x00-\x{24F}\x{2010}-\x{2027}]"


def _is_latin(char: str) -> bool:
    return any(ord(char) in span for span in LATIN_ONLY)


@lru_cache(maxsize=None)
def _latin_part(compose_only: bool):
    source, target, several = rules.compatibility_table() if compose_only else rules.folding_table()
    kept = [(a, b) for a, b in zip(source, target) if _is_latin(a)]
    gone = [a for a in source[len(target):] if _is_latin(a)]
    return (
        "".join([a for a, _ in kept] + gone),
        "".join(b for _, b in kept),
        tuple(pair for pair in several if _is_latin(pair[0])),
    )


def _class_of_first(pairs) -> str:
    return rules.character_class(first for first, _ in pairs)


@lru_cache(maxsize=None)
def _fold_sql() -> str:
    source, target, several = _latin_part(False)
    rest = tuple(pair for pair in several if pair[0] != "ß")
    latin = _let(
        "p",
        f"replace(translate(t, {_quoted(source)}, {_quoted(target)}), 'ß', 'ss')",
        _if_found("p", _class_of_first(rest), _replace_pairs("p", rest), "p"),
    )
    source, target, several = rules.folding_table()
    spread = _let(
        "p",
        f"translate(t, {_quoted(source)}, {_quoted(target)})",
        _if_found("p", _class_of_first(several), _replace_pairs("p", several), "p"),
    )
    whole = _let("h", spread, _if_found("h", "[가-힣]", _hangul_parts("h"), "h"))
    return (
        f"t -> CASE WHEN length(t) = octet_length(t) THEN lower(t) "
        f"WHEN NOT regexp_like(t, {_pattern(NOT_LATIN)}) THEN {latin} ELSE {whole} END"
    )


@lru_cache(maxsize=None)
def _compatible_sql() -> str:
    latin_source, _, latin_several = _latin_part(True)
    touched = rules.character_class(list(latin_source) + [char for char, _ in latin_several])
    unsafe = NOT_LATIN[:-1].replace("[^", "[[^") + "]" + touched[1:]
    source, target, several = rules.compatibility_table()
    spread = _let(
        "p",
        f"translate(t, {_quoted(source)}, {_quoted(target)})",
        _if_found("p", _class_of_first(several), _replace_pairs("p", several), "p"),
    )
    composed = _let("c", spread, _if_found("c", r"\p{M}", _replace_pairs("c", rules.composition_pairs()), "c"))
    return f"t -> CASE WHEN length(t) = octet_length(t) OR NOT regexp_like(t, {_pattern(unsafe)}) THEN t ELSE {composed} END"


def fold(text: Column | str) -> Column:
    """Search form: compatibility form, case folded, accents and Arabic marks dropped."""
    return _apply(_fold_sql(), F.coalesce(_col(text).cast("string"), F.lit("")))


def compatible(text: Column | str) -> Column:
    """Compatibility form (NFKC); composes base and mark pairs only where marks occur."""
    return _apply(_compatible_sql(), F.coalesce(_col(text).cast("string"), F.lit("")))


def words(text: Column | str) -> Column:
    return F.regexp_extract_all(_col(text), F.lit(WORD), F.lit(0))


def tokens(text: Column | str) -> Column:
    """Folded words of at least two characters, in text order."""
    return F.filter(words(fold(text)), lambda t: F.length(t) >= 2)


def strip(text: Column | str, chars: str = SPACE) -> Column:
    if chars == SPACE:
        return F.trim(_col(text), F.lit(SPACES))
    return F.regexp_replace(_col(text), f"^{chars}+|{chars}+$", "")


def rstrip(text: Column | str, chars: str = SPACE) -> Column:
    return F.regexp_replace(_col(text), f"{chars}+$", "")


def lstrip(text: Column | str, chars: str = SPACE) -> Column:
    return F.regexp_replace(_col(text), f"^{chars}+", "")


def squeeze(text: Column | str) -> Column:
    """Runs of white space as one blank, none at the ends; runs that are one blank already are not touched."""
    return F.trim(F.regexp_replace(_col(text), f" {SPACE}+|[{SPACE[1:-1]}&&[^ ]]{SPACE}*", " "))


def clean(text: Column | str) -> Column:
    """Collapse white space; null words become the empty string."""
    squeezed = squeeze(F.coalesce(_col(text).cast("string"), F.lit("")))
    longest = max(map(len, NULL_WORDS))
    return bind(
        squeezed, lambda v: F.when((F.length(v) <= longest) & F.lower(v).isin(*NULL_WORDS), "").otherwise(v)
    )


def facet_key(text: Column | str) -> Column:
    return strip(F.regexp_replace(fold(text), r"[^\p{L}\p{N}_]+", " "))


def has_phrase(token_array: Column, phrase: Column | str) -> Column:
    """True when the space-joined phrase occurs as consecutive whole tokens."""
    needle = F.lit(phrase) if isinstance(phrase, str) else phrase
    padded = F.concat(F.lit(" "), F.array_join(token_array, " "), F.lit(" "))
    return F.contains(padded, F.concat(F.lit(" "), needle, F.lit(" ")))


def padded(text: Column | str) -> Column:
    """Search form between two spaces, in which labels are looked for."""
    return F.concat(F.lit(" "), fold(text), F.lit(" "))


def labels_in(padded_text: Column, label_rules: Iterable[tuple[str, Sequence[str]]]) -> Column:
    """Labels with a needle anywhere in a ``padded`` text (substring test)."""
    hits = []
    for label, needles in label_rules:
        test = F.lit(False)
        for needle in needles:
            test = test | F.contains(padded_text, F.lit(needle))
        hits.append(F.when(test, F.lit(label)))
    return F.array_compact(F.array(*hits))


def matching_labels(text: Column, label_rules: Iterable[tuple[str, Sequence[str]]]) -> Column:
    """Labels with a needle anywhere in the folded, space-padded text (substring test)."""
    return bind(padded(text), lambda p: labels_in(p, label_rules))


def json_strings(value: Column | str) -> Column:
    """A JSON list, scalar or bare text as cleaned values, distinct by search form."""
    value = _col(value).cast("string")
    listed = F.from_json(value, "array<string>")
    scalar = F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")
    items = F.when(value.isNull(), F.array().cast("array<string>")).otherwise(
        F.coalesce(listed, F.array(F.coalesce(scalar, value)))
    )
    cleaned = F.filter(
        F.transform(items, lambda v: squeeze(F.coalesce(v, F.lit("")))), lambda v: v != ""
    )
    keyed = F.transform(cleaned, lambda v: F.struct(fold(v).alias("k"), v.alias("v")))
    return F.transform(
        F.filter(
            keyed,
            lambda item, i: ~F.exists(F.slice(keyed, F.lit(1), i), lambda seen: seen["k"] == item["k"]),
        ),
        lambda item: item["v"],
    )


def folded_set(values: Column) -> Column:
    return F.array_distinct(
        F.transform(F.filter(values, lambda v: strip(F.coalesce(v, F.lit(""))) != ""), fold)
    )


def share_of(found: Column, wanted: Column) -> Column:
    """Share of the distinct wanted tokens that were found; 0 when none is wanted."""
    total = F.size(F.array_distinct(wanted))
    return F.when(total > 0, F.size(F.array_intersect(wanted, found)) / total).otherwise(0.0)


def shared_tokens(left: Column, right: Column) -> Column:
    """Common tokens, longest first, then alphabetical."""
    return F.transform(
        F.array_sort(
            F.transform(
                F.array_intersect(left, right),
                lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")),
            )
        ),
        lambda s: s["t"],
    )


def ratio(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def count_chars(text: Column, java_class: str) -> Column:
    """Number of characters of the class; counts are over code points."""
    return F.length(text) - F.length(F.regexp_replace(text, java_class, ""))
