"""Page text, chunks, HTML cleaning, titles and stable identifiers."""

from __future__ import annotations

import html
import html.entities
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekgrain.functions import text as tx

CLOSED_REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);")

# Where a chunk may end, best first; separators of a display title.
BOUNDARIES = ("\n\n", "\n", ". ", "! ", "? ", "؟ ", "; ", ": ", ", ", " ")
TITLE_SEPARATORS = (" • ", " | ", "\n", " - Phase", " - Etape", " - Étape")


def clean_page(text: Column | str) -> Column:
    unified = F.regexp_replace(tx.compatible(text), r"\r\n|\r", "\n")
    return tx.strip(F.regexp_replace(unified, r"[\p{C}&&[^\n\t]]+", ""))


def digital_text_usable(text: Column, characters: int = 80, words: int = 10) -> Column:
    return (F.length(text) >= characters) & (F.size(tx.words(text)) >= words)


def page_quality(text: Column, method: Column, confidence: Column) -> Column:
    return (
        F.when(tx.strip(text) == "", "FAILED")
        .when(F.length(text) < 20, "REVIEW")
        .when((method == "tesseract_ocr") & (F.coalesce(confidence, F.lit(0.0)) < 35), "REVIEW")
        .otherwise("PASS")
    )


def ocr_confidence(confidences: Column) -> Column:
    """Mean of the non-negative word confidences; null without any."""
    kept = F.filter(confidences, lambda c: c >= 0)
    return F.when(
        F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda a, c: a + c.cast("double")) / F.size(kept)
    )


def chunk_spans(text: str, maximum: int, overlap: int, minimum: int) -> list[tuple[int, int]]:
    """(start, end) of every chunk; a chunk ends after the last boundary in its window."""
    spans, start, size = [], 0, len(text)
    while start < size:
        end = min(start + maximum, size)
        if end < size:
            low = min(start + minimum, end)
            found, order = max((text.rfind(mark, low, end + 1), -i) for i, mark in enumerate(BOUNDARIES))
            if found >= low:
                end = found + len(BOUNDARIES[-order])
        piece = text[start:end]
        body = piece.strip()
        if body:
            lead = len(piece) - len(piece.lstrip())
            spans.append((start + lead, start + lead + len(body)))
        if end >= size:
            break
        start = max(end - overlap, start + 1)
    return spans


def chunk_pages(
    pages: DataFrame, text: str, maximum: int = 900, overlap: int = 120, minimum: int = 120
) -> DataFrame:
    """One row per chunk of each page: index, offsets, text and search form."""
    if maximum <= overlap or minimum <= 0:
        raise ValueError("invalid chunk sizes")

    @F.pandas_udf("array<int>")
    def ends(texts: pd.Series) -> pd.Series:
        # Starts and ends in turn, as plain numbers: a batch holds thousands of pages.
        return texts.map(lambda t: np.array(chunk_spans(t or "", maximum, overlap, minimum), dtype=np.int32).ravel())

    others = [c for c in pages.columns if c != text]
    spans = F.transform(
        F.filter("_ends", lambda _, i: i % 2 == 0),
        lambda start, i: F.struct(start.alias("character_start"), F.get("_ends", 2 * i + 1).alias("character_end")),
    )
    placed = pages.withColumn("_ends", ends(F.col(text))).withColumn("_spans", spans)
    return (
        placed.select(*others, text, F.posexplode("_spans").alias("_i", "_span"))
        .select(
            *others,
            (F.col("_i") + 1).alias("chunk_index"),
            "_span.character_start",
            "_span.character_end",
            F.substring(
                F.col(text),
                F.col("_span.character_start") + 1,
                F.col("_span.character_end") - F.col("_span.character_start"),
            ).alias("original_text"),
        )
        .withColumn("retrieval_text", tx.fold("original_text"))
    )


def _closed_reference(match: re.Match) -> str:
    known = match[0][1] == "#" or match[0][1:] in html.entities.html5
    return html.unescape(match[0]) if known else match[0]


def unescape_html(value: Column, closed: bool = False) -> Column:
    """Named and numeric character references; the entity table lives in the standard library.

    ``closed`` leaves references without their semicolon, such as one cut off by a length, as they stand.
    """

    def unescape(texts: pd.Series) -> pd.Series:
        if closed:
            return texts.map(lambda t: CLOSED_REFERENCE.sub(_closed_reference, t), na_action="ignore")
        return texts.map(html.unescape, na_action="ignore")

    # A text without the sign stays in the JVM.
    marked = F.when(F.contains(value, F.lit("&")), value)
    return F.coalesce(F.pandas_udf(unescape, T.StringType())(marked), value)


def strip_markup(decoded: Column | str, maximum: int | None = None) -> Column:
    """Drop scripts, styles, tags and control characters from unescaped text; tidy the lines."""
    body = F.regexp_replace(
        tx._col(decoded), r"(?is)<(?:script|style)(?![\p{L}\p{N}_])[^>]*>.*?</(?:script|style)>", ""
    )
    body = F.regexp_replace(F.regexp_replace(body, r"<[^>]*>", ""), r"[\p{C}&&[^\n\r]]+", "")
    lines = F.transform(F.split(F.regexp_replace(body, " +", " "), tx.LINE_BREAK), lambda line: tx.strip(line))
    tidy = F.array_join(F.filter(lines, lambda line: line != ""), "\n")
    return tidy if maximum is None else F.left(tidy, F.lit(maximum))


def sanitize_html(value: Column | str, maximum: int | None = None, closed: bool = False) -> Column:
    return strip_markup(unescape_html(F.coalesce(tx._col(value), F.lit("")), closed), maximum)


def source_label(value: Column | str) -> Column:
    """File name without its folder, safe to display."""
    name = F.substring_index(F.replace(tx._col(value), F.lit("\\"), F.lit("/")), "/", -1)
    return sanitize_html(name, 180)


def short_title(value: Column, fallback: Column, default: str = "Reference", maximum: int = 52) -> Column:
    """First sentence or bullet, cut on a word without a dangling connector."""
    tail = "[ ,;:\\-]"
    text = F.coalesce(
        F.nullif(tx.clean(value), F.lit("")), F.nullif(tx.clean(fallback), F.lit("")), F.lit(default)
    )
    first = tx.strip(F.split(text, r"[•\n]|(?<=[.!?])" + tx.SPACE + "+", 2)[0])
    head = F.left(first, F.lit(maximum))
    cut = tx.rstrip(F.regexp_replace(head, r"(?s) [^ ]*$", ""), tail)
    # Connectors that may not end a title.
    cut = tx.rstrip(
        F.regexp_replace(
            cut, "(?iu)" + tx.SPACE + r"+(?:à|au|aux|de|des|du|d['’]|en|et|pour|vers)$", ""
        ),
        tail,
    )
    return F.when(F.length(first) <= maximum, first).otherwise(
        F.when(cut != "", cut).otherwise(tx.rstrip(head, tail))
    )


def display_title(title: Column, client: Column, fallback: str = "Reference", maximum: int = 96) -> Column:
    """First clause when long enough, at most ``maximum`` characters on a word boundary."""
    edge, tail = "[ \\-•|]", "[ \\-•|,.;:]"
    base = tx.strip(tx.squeeze(F.coalesce(title, F.lit(""))), edge)
    chosen = base
    for separator in reversed(TITLE_SEPARATORS):
        clause = tx.strip(F.substring_index(base, separator, 1), tail)
        chosen = F.when(F.contains(base, F.lit(separator)) & (F.length(clause) >= 18), clause).otherwise(chosen)
    named = F.when(chosen != "", chosen).otherwise(
        tx.squeeze(F.coalesce(F.nullif(client, F.lit("")), F.lit(fallback)))
    )
    window = F.left(named, F.lit(maximum + 1))
    cut = F.when(F.contains(window, F.lit(" ")), F.regexp_replace(window, r"(?s) [^ ]*$", "")).otherwise(window)
    short = tx.rstrip(cut, tail)
    return F.when(F.length(named) <= maximum, named).otherwise(
        F.when(short != "", short).otherwise(tx.rstrip(F.left(named, F.lit(maximum))))
    )


def stable_id(*parts: Column | str) -> Column:
    """SHA-256 of the parts joined by the unit separator."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(tx._col(p).cast("string"), F.lit("")) for p in parts]), 256)


def canonical_json_hash(row: Column) -> Column:
    """SHA-256 of a struct as compact JSON; give the struct its fields in sorted order."""
    return F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256)
