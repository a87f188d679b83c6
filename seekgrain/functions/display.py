"""Readable evidence text derived from a passage, as native expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from seekgrain.functions import text as tx
from seekgrain.functions import vocabulary as vocab

# Layout patterns and the phrases a project description starts with.
BULLET = r"^(?:[-*•▪◦‣]|\p{Nd}+[.)])" + tx.SPACE + "+"
HYPHEN_TAIL = r"^[A-Za-zÀ-ÖØ-öø-ÿ]{3}-$"
CONTINUATION = r"^[a-zà-öø-ÿ]{2,}"
ROLE_PREFIX = r"(?iu)^(?:passage|query)" + tx.SPACE + "*:" + tx.SPACE + "*"
SENTENCE_END = r"(?<=[.!?؟])(?=" + tx.SPACE + ")"
HONORIFIC = r"(?iu)(?<![\p{L}\p{N}_])(?:m|mr|mme|mlle|dr)\.$"
FOCUS = (
    r"(?iu)(?<![\p{L}\p{N}_])(?:ARTICLE\s+\p{Nd}+\s*:\s*OBJET|OBJET\s+(?:DU\s+CONTRAT|DE\s+LA\s+MISSION)|"
    r"(?:%s)(?![\p{L}\p{N}_]).{0,90}(?<![\p{L}\p{N}_])(?:a\s+r[ée]alis[ée]|"
    r"est\s+en\s+cours\s+de\s+r[ée]alisation|nous\s+assiste|a\s+accompagn[ée])|project\s+scope)"
    r"(?![\p{L}\p{N}_])|نطاق\s+المشروع"
)
SHORT_LINE = 100
MAXIMUM = 700
TAIL_FROM = 40
SENTENCE_FROM = 120
WORD_CUT_FROM = 180


def readable_lines(text: Column) -> Column:
    """Line feeds only, no control or format characters, no role prefix."""
    unified = F.regexp_replace(tx.compatible(text), r"\r\n|\r", "\n")
    visible = F.regexp_replace(unified, r"[\p{C}&&[^\n\t]]+", "")
    return F.regexp_replace(visible, ROLE_PREFIX, "")


def _paragraph(raw: Column) -> Column:
    lines = F.filter(
        F.transform(
            F.split(raw, tx.LINE_BREAK), lambda line: tx.strip(F.regexp_replace(line, r"[ \t]+", " "))
        ),
        lambda line: line != "",
    )
    keyed = F.transform(lines, lambda line: F.struct(line.alias("line"), tx.fold(line).alias("key")))
    start = F.struct(
        F.lit(None).cast("string").alias("text"),
        F.lit(None).cast("string").alias("last"),
        F.array().cast("array<string>").alias("seen"),
    )

    def step(state: Column, item: Column) -> Column:
        short = F.length(item["line"]) <= SHORT_LINE
        repeated = F.coalesce(state["last"] == item["key"], F.lit(False)) | (
            short & F.array_contains(state["seen"], item["key"])
        )
        glued = (
            F.when(state["text"].isNull(), item["line"])
            .when(
                F.regexp_like(F.right(state["text"], F.lit(4)), F.lit(HYPHEN_TAIL))
                & F.regexp_like(item["line"], F.lit(CONTINUATION)),
                F.concat(F.left(state["text"], F.length(state["text"]) - 1), item["line"]),
            )
            .when(F.regexp_like(item["line"], F.lit(BULLET)), F.concat(state["text"], F.lit("\n"), item["line"]))
            .otherwise(F.concat(state["text"], F.lit(" "), item["line"]))
        )
        return F.when(repeated, state).otherwise(
            F.struct(
                glued.alias("text"),
                item["key"].alias("last"),
                F.when(short, F.array_append(state["seen"], item["key"])).otherwise(state["seen"]).alias("seen"),
            )
        )

    joined = F.aggregate(keyed, start, step, lambda state: state["text"])
    return tx.strip(F.regexp_replace(joined, r"[ \t]+", " "))


def clean_display(text: Column | str) -> Column:
    paragraphs = F.split(readable_lines(tx._col(text)), r"\n" + tx.SPACE + r"*\n+")
    kept = F.filter(F.transform(paragraphs, _paragraph), lambda p: p.isNotNull() & (p != ""))
    return F.array_join(kept, "\n\n")


def focus_passage(cleaned: Column, providers: Sequence[str] = ("le\\s+Cabinet",)) -> Column:
    """Start at the first project marker and end on a sentence, within 700 characters."""
    pattern = FOCUS % "|".join(providers)

    def from_marker(text: Column) -> Column:
        return tx.bind(
            F.regexp_instr(text, F.lit(pattern)),
            lambda at: F.when(at > 0, F.substring(text, at, F.length(text))).otherwise(text),
        )

    def usable_ends(window: Column) -> Column:
        """End positions of sentences from the minimum on, without honorifics."""

        def ends(parts: Column) -> Column:
            return F.transform(
                F.sequence(F.lit(1), F.size(parts)), lambda i: F.length(F.array_join(F.slice(parts, 1, i), ""))
            )

        return F.filter(
            tx.bind(F.split(window, SENTENCE_END), ends),
            lambda end: (end >= SENTENCE_FROM)
            & F.regexp_like(F.substring(window, end, F.lit(1)), F.lit("[.!?؟]"))
            & ~F.regexp_like(
                F.substring(window, F.greatest(end - 7, F.lit(0)) + 1, F.least(end, F.lit(7))), F.lit(HONORIFIC)
            ),
        )

    def word_cut(head: Column) -> Column:
        space = F.lit(MAXIMUM) - F.locate(" ", F.reverse(head))
        return F.when(F.contains(head, F.lit(" ")) & (space >= WORD_CUT_FROM), space).otherwise(MAXIMUM)

    def cut(text: Column) -> Column:
        chosen = tx.bind(
            tx.bind(F.left(text, F.lit(MAXIMUM + 1)), usable_ends),
            lambda ends: F.when(F.size(ends) > 0, ends[F.least(F.lit(1), F.size(ends) - 1)]).when(
                F.length(text) > MAXIMUM, tx.bind(F.left(text, F.lit(MAXIMUM)), word_cut)
            ),
        )
        return tx.bind(
            chosen,
            lambda n: F.when(n.isNull(), text).otherwise(
                F.concat(
                    tx.rstrip(F.left(text, n), "[ ,;:]"), F.when(n < F.length(text), "…").otherwise("")
                )
            ),
        )

    return tx.bind(tx.bind(tx.strip(cleaned), from_marker), cut)


def display_text(text: Column | str, providers: Sequence[str] = ("le\\s+Cabinet",)) -> Column:
    """Clean, drop the contact or signature tail, focus."""

    def untail(cleaned: Column) -> Column:
        return tx.bind(
            F.regexp_instr(cleaned, F.lit(vocab.CONTACT_PATTERN)) - 1,
            lambda at: F.when(
                at >= TAIL_FROM, tx.rstrip(F.left(cleaned, at), "[ ,;:.\\-–—]")
            ).otherwise(cleaned),
        )

    return tx.bind(
        clean_display(text), lambda cleaned: focus_passage(tx.bind(cleaned, untail), providers)
    )
