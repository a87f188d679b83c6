"""Hashed words and word shingles of text columns, with numpy inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_FACTORS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
     0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64,
)

_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[ord("A") : ord("Z") + 1] += 32
_IN_WORD = np.ones(256, bool)
_IN_WORD[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of a word up to which it is hashed together with the others.
LONG_WORD = 256


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): 64-bit hashes of the words, A-Z lowered, split at ASCII white space; null has none.

    The eight bytes at a place of all words are taken in at once; a very long word is hashed by itself.
    """
    own = texts.fill_null("").cast(pa.large_string()).take(pa.array(np.arange(len(texts))))  # own buffers, not a slice's
    ends = np.frombuffer(own.buffers()[1], np.int64)[: len(own) + 1] if len(own) else np.zeros(1, np.int64)
    held = own.buffers()[2] if len(own) else None
    raw = np.frombuffer(held, np.uint8)[: ends[-1]] if held is not None else np.zeros(0, np.uint8)
    signs = np.zeros(len(raw) + 8, np.uint8)
    signs[: len(raw)] = _LOWERED[raw]
    inner = _IN_WORD[raw]
    opens, closes = inner.copy(), inner.copy()
    opens[1:] &= ~inner[:-1]
    closes[:-1] &= ~inner[1:]
    edge = ends[(ends > 0) & (ends < len(raw))]  # a word ends with its text
    opens[edge] = inner[edge]
    closes[edge - 1] = inner[edge - 1]
    start = np.flatnonzero(opens)
    size = np.flatnonzero(closes) + 1 - start
    at_place = np.ndarray((len(raw) + 1,), np.dtype("<u8"), signs, strides=(1,))
    hashes = mixed(size.astype(np.uint64) ^ _FACTORS[0])
    rows, place = np.flatnonzero(size <= LONG_WORD), 0
    while len(rows):
        left = np.minimum(size[rows] - place, 8).astype(np.uint64)
        part = at_place[start[rows] + place] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left))
        hashes[rows] = mixed(hashes[rows] ^ part)
        place += 8
        rows = rows[size[rows] > place]
    for row in np.flatnonzero(size > LONG_WORD).tolist():
        word = signs[start[row] : start[row] + size[row]].tobytes()
        hashes[row] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
    return hashes, np.searchsorted(start, ends)


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, owners) of all runs of ``width`` words, in place order."""
    n = max(0, len(words) - width + 1)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    total = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        total += words[k : k + n] * (_FACTORS[k % 8] + np.uint64(2 * (k // 8)))
    whole = owner[:n] == owner[width - 1 :][:n]
    return mixed(total)[whole], owner[:n][whole]


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets): sorted distinct shingle hashes of every text.

    A text with fewer words than ``width`` has its whole sequence as its one shingle; without words it has none.
    """
    words, offsets = word_hashes(texts)
    values, owner = shingle_hashes(words, offsets, width)
    counts = np.diff(offsets)
    few = np.flatnonzero((counts > 0) & (counts < width))
    if len(few):
        # Rows of one length are shingles of that width.
        for length in np.unique(counts[few]).tolist():
            rows = few[counts[few] == length]
            at = offsets[rows][:, None] + np.arange(length)
            one, _ = shingle_hashes(words[at].ravel(), np.arange(len(rows) + 1) * length, length)
            values, owner = np.r_[values, mixed(one + np.uint64(length))], np.r_[owner, rows]
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.r_[0, np.cumsum(np.bincount(owner, minlength=len(counts)))]


def text_runs(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 21, rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """The batch in slices of ``rows`` rows whose texts have about ``most`` bytes; one longer text is a slice of its own."""
    sizes = pc.binary_length(batch.column(column).fill_null("")).to_numpy(zero_copy_only=False)
    ends = np.r_[0, np.cumsum(sizes.astype(np.int64))]
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most, side="right")) - 1)
        stop = min(stop, start + rows)
        yield batch.slice(start, stop - start)
        start = stop
