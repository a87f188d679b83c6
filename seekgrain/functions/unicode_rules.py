"""Character tables derived from the Unicode database by rule.

Search folding and compatibility composition work one character at a time for nearly all text,
so both become plain ``translate`` calls that stay inside the JVM. The few characters that fold
to several characters are replaced only in rows that hold one.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

# Arabic letter forms folded together, and the marks dropped before that.
ARABIC_LETTERS = {"أ": "ا", "إ": "ا", "آ": "ا", "ٱ": "ا", "ى": "ي", "ؤ": "و", "ئ": "ي"}
ARABIC_MARK_RANGES = ((0x0610, 0x061A), (0x064B, 0x065F), (0x0670, 0x0670), (0x06D6, 0x06ED))
TATWEEL = "ـ"

HANGUL = (0xAC00, 0xD7A3)


def fold_character(char: str) -> str:
    """Search form of one character: compatibility form, case folded, no marks."""
    out = []
    for piece in unicodedata.normalize("NFKC", char).casefold():
        code = ord(piece)
        if piece == TATWEEL or any(low <= code <= high for low, high in ARABIC_MARK_RANGES):
            continue
        out.append(ARABIC_LETTERS.get(piece, piece))
    return "".join(c for c in unicodedata.normalize("NFKD", "".join(out)) if not unicodedata.combining(c))


def compatible_character(char: str) -> str:
    return unicodedata.normalize("NFKC", char)


def _assigned():
    for code in (*range(0x20000), *range(0x2F800, 0x2FA20)):
        if HANGUL[0] <= code <= HANGUL[1] or 0x4E00 <= code <= 0x9FFF or 0xD800 <= code <= 0xF8FF:
            continue
        char = chr(code)
        if unicodedata.category(char) != "Cn":
            yield char


def _table(rule):
    source, target, dropped, several = [], [], [], []
    for char in _assigned():
        folded = rule(char)
        if folded == char:
            continue
        if len(folded) == 1:
            source.append(char)
            target.append(folded)
        elif folded:
            several.append((char, folded))
        else:
            dropped.append(char)
    return "".join(source + dropped), "".join(target), tuple(several)


@lru_cache(maxsize=None)
def folding_table():
    return _table(fold_character)


@lru_cache(maxsize=None)
def compatibility_table():
    return _table(compatible_character)


@lru_cache(maxsize=None)
def composition_pairs() -> tuple[tuple[str, str], ...]:
    """(base + mark, composed) pairs, shallow compositions first."""
    pairs = []
    for char in _assigned():
        parts = unicodedata.decomposition(char).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            pair = chr(int(parts[0], 16)) + chr(int(parts[1], 16))
            if unicodedata.normalize("NFC", pair) == char:
                pairs.append((len(unicodedata.normalize("NFD", char)), pair, char))
    return tuple((pair, char) for _, pair, char in sorted(pairs))


def character_class(chars) -> str:
    """A Java regex class that matches exactly these characters."""
    codes = sorted({ord(c) for c in chars})
    spans: list[list[int]] = []
    for code in codes:
        if spans and code == spans[-1][1] + 1:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    return "[" + "".join(
        f"\\x{{{low:x}}}" if low == high else f"\\x{{{low:x}}}-\\x{{{high:x}}}" for low, high in spans
    ) + "]"
