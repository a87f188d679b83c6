"""Personal data: regular expressions propose spans, checksums confirm them, context adjusts the score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekgrain.llm.common import unused

#: Patterns in possessive form: no part can give back what the next one needs, so they cost linear time.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Length of an account number by country code.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN = (
    r"(?<![A-Za-z0-9])(?:"
    + "|".join(
        rf"(?:{'|'.join(countries.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{length - 4}}}" for length, countries in IBAN_LENGTHS.items()
    )
    + r")(?![A-Za-z0-9])"
)
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban")
#: Characters before and after a span in which its context words are looked for.
NEAR = 40
CONTEXT = {
    "email": "e-?mail|contact|mailto|courriel|correo",
    "ip": "ip|host|server|address|login|adresse",
    "card": "card|visa|credit|payment|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|telefon|teléfono",
    "iban": "iban|account|bank|konto|compte|cuenta",
}
#: Score of a confirmed span, and what a context word adds. Kinds with a checksum are surer by themselves.
SCORES = {"email": (0.8, 0.2), "ip": (0.6, 0.3), "card": (0.8, 0.2), "phone": (0.5, 0.4), "iban": (0.9, 0.1)}


def found_spans(text: Column, pattern: str, keep, make) -> Column:
    """array of ``make(span, near)`` for the matches of ``pattern`` whose value passes ``keep``.

    A span has start, end (exclusive) and value, in code points; near are the NEAR signs on either side.
    Splitting at the pattern and extracting it walk over the same matches, so the lengths of gaps and
    matches in turn give the places. Lists are added to in blocks of about the root of their length, and
    what stands near is put together from neighbouring pieces, so that no step walks through the text anew.
    """
    pairs = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit")
    )

    def length(pair: Column) -> Column:
        return F.length(pair["gap"]) + F.coalesce(F.length(pair["hit"]), F.lit(0))

    def step(state: Column, pair: Column) -> Column:
        end = state["at"] + length(pair)
        start = end - F.coalesce(F.length(pair["hit"]), F.lit(0))
        number = state["number"] + 1
        span = F.struct(start.alias("start"), end.alias("end"), pair["hit"].alias("value"), number.alias("number"))
        return F.struct(end.alias("at"), number.alias("number"), F.concat(state["spans"], F.array(span)).alias("spans"))

    none = F.array().cast("array<struct<start: int, end: int, value: string, number: int>>")

    def spans_from(pairs: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(pairs))).cast("int")
        firsts = F.sequence(F.lit(0), F.size(pairs) - 1, size)
        lengths = F.transform(firsts, lambda k: F.aggregate(F.slice(pairs, k + 1, size), F.lit(0), lambda n, p: n + length(p)))

        def sums(lengths: Column) -> Column:
            first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
            return F.aggregate(
                lengths, first, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")), lambda s: s["all"]
            )

        def block(z: Column) -> Column:
            first = F.struct(z["at"].alias("at"), (z["k"] - 1).alias("number"), none.alias("spans"))
            return F.aggregate(F.slice(pairs, z["k"] + 1, size), first, step, lambda s: s["spans"])

        starts = F.transform(F.array(lengths), sums)[0]
        return F.flatten(F.transform(F.arrays_zip(firsts.alias("k"), starts.alias("at")), block))

    def near(befores: Column, afters: Column, number: Column) -> Column:
        # Every match has a sign, so NEAR signs lie within 2 NEAR pieces; each was cut to what can count.
        low = F.greatest(number - NEAR, F.lit(0))
        before = F.array_join(F.slice(befores, low + 1, number - low + 1), "")
        after = F.array_join(F.slice(afters, number + 2, F.lit(NEAR + 1)), "")
        return F.concat_ws(" ", F.right(before, F.lit(NEAR)), F.left(after, F.lit(NEAR)))

    def with_pairs(pairs: Column) -> Column:
        kept = F.filter(spans_from(pairs), lambda s: s["value"].isNotNull() & keep(s["value"]))
        # A match and the gap before it, as far as they can stand before the next match or after the last one.
        before = F.transform(
            pairs, lambda p, i: F.concat(F.coalesce(F.right(F.get(pairs, i - 1)["hit"], F.lit(NEAR)), F.lit("")), F.right(p["gap"], F.lit(NEAR)))
        )
        after = F.transform(
            pairs, lambda p: F.concat(F.left(p["gap"], F.lit(NEAR)), F.coalesce(F.left(p["hit"], F.lit(NEAR)), F.lit("")))
        )

        def made(kept: Column) -> Column:
            sides = F.array(F.struct(before.alias("before"), after.alias("after")))
            each = F.transform(sides, lambda c: F.transform(kept, lambda s: make(s, near(c["before"], c["after"], s["number"]))))[0]
            return F.when(F.size(kept) > 0, each)

        return F.transform(F.array(kept), made)[0]  # bound, so that it is worked out once

    return F.transform(F.array(pairs), with_pairs)[0]


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def luhn(number: Column) -> Column:
    """Doubling every second digit from the right, the digit sum is a multiple of ten."""
    places = F.sequence(F.lit(1), F.length(number))

    def add(total: Column, i: Column) -> Column:
        d = F.substr(F.reverse(number), i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def mod97(value: Column) -> Column:
    """The account number, first four signs last and letters as 10 to 35, leaves 1 modulo 97."""
    bare = F.replace(value, F.lit(" "), F.lit(""))
    moved = F.concat(F.substr(bare, F.lit(5)), F.substring(bare, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        sign = F.substr(moved, i, F.lit(1))
        number = F.when(sign.rlike("[0-9]"), sign.try_cast("int")).otherwise(F.ascii(sign) - 55)
        return F.when(number > 9, rest * 100 + number).otherwise(rest * 10 + number) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), add) == 1


def _confirmed(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda part: part.cast("double") <= 255)
    if kind == "card":
        return F.when(F.length(digits(value)).between(12, 19), luhn(digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    if kind == "iban":
        return mod97(value)
    return F.lit(True)


#: What a text must hold before the pattern of a kind is tried.
_GUARD = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"),
    "phone": lambda t: F.contains(t, F.lit("+")),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]"),
}
_PATTERN = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN}


def find_pii(docs: DataFrame, text: str = "text", result: str = "pii") -> DataFrame:
    """``docs`` with array ``result`` of (kind, start, end, value, score), by start and then kind order.

    Base kinds are email, ip, card (Luhn) and phone; the method adds iban (mod 97). A span's score is
    raised when a context word of its kind stands within NEAR characters. Null and empty texts give an
    empty array; rows are handled one by one, so repeats, ties and empty tables need no rule. A column
    named like the result is replaced. Long texts cost in proportion to their length, and lists of n
    matches about n times the root of n short copies.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    parts = "array<struct<start: int, order: int, kind: string, end: int, value: string, score: double>>"

    def spans(kind: str, order: int) -> Column:
        base, more = SCORES[kind]

        def scored(s: Column, near: Column) -> Column:
            known = near.rlike(rf"(?i)(?<![\p{{L}}])(?:{CONTEXT[kind]})")
            score = F.when(known, F.lit(base + more)).otherwise(F.lit(base))
            return F.struct(
                s["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"),
                s["end"].alias("end"), s["value"].alias("value"), F.round(score, 2).alias("score"),
            )

        found = found_spans(whole, _PATTERN[kind], lambda value: _confirmed(kind, value), scored)
        return F.coalesce(F.when(_GUARD[kind](whole), found), F.array()).cast(parts)

    columns: dict[str, str] = {}
    for kind in KINDS:
        columns[kind] = unused(docs, "_" + kind)
    df = docs.withColumns({c: spans(kind, order) for order, (kind, c) in enumerate(columns.items())})
    lists = [F.col(c) for c in columns.values()]
    fields = ("kind", "start", "end", "value", "score")
    ordered = F.transform(F.sort_array(F.concat(*lists)), lambda s: F.struct(*[s[f].alias(f) for f in fields]))
    return df.withColumn(result, ordered).drop(*columns.values())


def span_list(spans: Column, kinds=KINDS) -> Column:
    """kind:start:end of the spans of ``kinds``, comma-joined."""
    kept = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
