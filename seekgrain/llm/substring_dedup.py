"""Near-duplicate passages by compact windows.

A document is a sequence of hashed word shingles. Under one hash function the sub-sequences whose
minimum is the same token form a node of the Cartesian tree over the token hashes. Only nodes wide
enough to hold a passage matter: those are the runs of equal minima of a sliding window of passage
length, and there are about 2 / length of them per token. Nodes of different documents with equal
minima form a group. At first every window is set against two windows of its group, the first ones of
the smallest and of the largest document, so a group of m windows gives 2 m pairs at most.
The intervals of all hash functions are laid over each other; where enough functions find a partner,
the intervals are joined per partner and alignment, and these candidates verified on their shingles.
Where two functions agree on their minima, a pair of windows overlaps in a place with a key of its own; starts
that are in no verified passage are looked for among the places of other documents with the same key, block
against block, until they are verified or have met all of them. A shingle that many texts share makes a large
group of windows, but not of such places.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seekgrain.llm.common import dropped, giving_back, settled
from seekgrain.llm.jaccard_join import NAMELESS, least_overlap, whole_groups
from seekgrain.llm.shingles import mixed, shingle_hashes, text_runs, word_hashes

SHINGLE = 5
#: Words of the shortest passage.
LEAST_WORDS = 50
FUNCTIONS = 4
#: Hash functions that must agree on a place.
ENOUGH = 2
PERCENT = 80
#: Spans of all documents, two numbers each, up to which they are broadcast to the texts; else both shuffle.
BROADCAST_SPANS = 2_000_000
#: Windows of a group that look for partners at once, and that they are set against at once.
BLOCK_ROWS = 2048
#: Pairs of them whose masks, and whose shingles, are compared at once.
PAIRS_AT_ONCE, SIDE_BY_SIDE = 1 << 17, 1 << 13
WINDOW_SCHEMA = "key long, node long, place long"
BLOCK_COLUMNS = ("block", "node", "place", "low", "high", "both", "repeats")
BLOCK_SCHEMA = "block long, node long, place long, low long, high long, both boolean, repeats boolean, tokens binary"
#: Bits of the fine mask of a place, and pairs of a block per row of it from which its shingles are looked up first.
FINE_BITS, CROWDED = 1024, 16
#: Shingles up to which windows with repeats are compared as a matrix.
DENSE = 256
#: Rows of blocks that are put together at once.
ROWS_AT_ONCE = 1 << 16


def sliding_minimum(values: np.ndarray, length: int) -> np.ndarray:
    """Minimum of every run of ``length`` values, from minima of blocks taken from both sides."""
    n = len(values) - length + 1
    if n <= 0:
        return np.zeros(0, values.dtype)
    padded = np.full(-(-len(values) // length) * length, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, length)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[length - 1 : length - 1 + n])


def compact_windows(tokens: np.ndarray, owner: np.ndarray, length: int, function: int):
    """(minimum, owner, first, centre, last) of the runs of starts whose window has one minimum; global places."""
    values = mixed(tokens ^ mixed(np.uint64(function + 1)))
    least = sliding_minimum(values, length)
    n = len(least)
    starts = np.flatnonzero(owner[:n] == owner[length - 1 :][:n])
    if not len(starts):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none, none
    least = least[starts]
    fresh = np.r_[True, (least[1:] != least[:-1]) | (starts[1:] != starts[:-1] + 1) | (owner[starts[1:]] != owner[starts[:-1]])]
    begin = np.flatnonzero(fresh)
    run = np.cumsum(fresh) - 1
    fresh |= (np.arange(len(starts)) - begin[run]) % length == 0  # a token that comes again and again
    begin = np.flatnonzero(fresh)
    first, last = starts[begin], starts[np.r_[begin[1:], len(starts)] - 1]
    centre = np.empty(len(first), np.int64)
    for s in range(0, len(first), 1 << 14):
        at = first[s : s + (1 << 14), None] + np.arange(length)
        centre[s : s + (1 << 14)] = (values[at] == least[begin[s : s + (1 << 14)], None]).argmax(axis=1)
    return least[begin], owner[first], first, first + centre, last


def _tokens(part: pa.RecordBatch, shingle: int):
    words, offsets = word_hashes(part.column("text"))
    tokens, owner = shingle_hashes(words, offsets, shingle)
    return tokens, owner, np.r_[0, np.cumsum(np.bincount(owner, minlength=part.num_rows))]


def _windows(shingle: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_runs(batch):
                tokens, owner, offsets = _tokens(part, shingle)
                node = part.column("node").to_numpy()
                for function in range(FUNCTIONS):
                    least, of, first, centre, last = compact_windows(tokens, owner, length, function)
                    start = first - offsets[of]
                    place = (start << 18) | ((centre - first) << 11) | ((last - first) << 4) | function
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(least.view(np.int64)), pa.array(node[of]), pa.array(place)], names=["key", "node", "place"]
                    )

    return giving_back(run)


def _regions(group: np.ndarray, low: np.ndarray, high: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, first, last) of the maximal places that ``least`` or more intervals of a group cover."""
    of = np.r_[group, group]
    at = np.r_[low, high + 1]
    step = np.r_[np.ones(len(low), np.int64), -np.ones(len(low), np.int64)]
    order = np.lexsort((at, of))
    of, at, step = of[order], at[order], step[order]
    final = np.r_[(at[1:] != at[:-1]) | (of[1:] != of[:-1]), True] if len(at) else np.zeros(0, bool)
    cover = np.cumsum(step)[final]  # the steps of a group add up to nothing
    of, at = of[final], at[final]
    enough = cover >= least
    opens = enough & ~np.r_[False, enough[:-1]]
    closes = ~enough & np.r_[False, enough[:-1]]
    return of[opens], at[opens], at[closes] - 1


def _passages(length: int):
    """Candidate passages per pair of documents and alignment.

    Where ENOUGH functions find a partner for a place of a document, whichever partner each of them
    has met, every partner's intervals there, joined, are candidates.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "node"):
            columns = ("node", "other", "shift", "low", "high", "function")
            node, other, shift, low, high, function = (table.column(c).to_numpy() for c in columns)
            of_node = np.cumsum(np.r_[False, node[1:] != node[:-1]])
            span = int(high.max()) + 2
            # Every function once, whatever its partners; then the places that enough of them share.
            group, first, last = _regions(of_node * FUNCTIONS + function, low, high, 1)
            group, first, last = _regions(group // FUNCTIONS, first, last, ENOUGH)
            if not len(group):
                continue
            begin, end = group * span + first, group * span + last
            next_region = np.minimum(np.searchsorted(end, of_node * span + low), len(end) - 1)
            inside = (begin[next_region] <= of_node * span + high) & (end[next_region] >= of_node * span + low)
            node, other, shift, low, high = (x[inside] for x in (node, other, shift, low, high))
            order = np.lexsort((shift, other, node))
            same = [x[order][1:] != x[order][:-1] for x in (node, other, shift)]
            pair = np.empty(len(node), np.int64)
            pair[order] = np.cumsum(np.r_[False, same[0] | same[1] | same[2]])
            where, first, last = _regions(pair, low, high, 1)
            row = np.empty(len(node), np.int64)
            row[pair] = np.arange(len(node))
            row, start, stop = row[where], first, last + length
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (node[row], start, stop, other[row], start + shift[row], stop + shift[row])],
                names=["node", "start", "stop", "other", "other_start", "other_stop"],
            )

    return giving_back(run)


def _slices(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_runs(batch):
                tokens, _, offsets = _tokens(part, shingle)
                rows = []
                for at, (node, wanted) in enumerate(zip(part.column("node").to_pylist(), part.column("wanted").to_pylist())):
                    own = tokens[offsets[at] : offsets[at + 1]]
                    own = own.astype(np.uint32)  # half of each hash tells the few hundred shingles of a passage apart
                    rows += [(node, w["start"], w["stop"], own[w["start"] : w["stop"]].tobytes()) for w in wanted]
                columns = list(zip(*rows)) or [[], [], [], []]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], names=["node", "start", "stop", "tokens"]
                )

    return giving_back(run)


def _block_rows(shingle: int, length: int):
    """(block, node, place, low, high, both, repeats, tokens) of the places that a text is asked for.

    A place that looks for partners in a block and is looked at there too is one row, marked ``both``;
    ``repeats`` marks a place in which a shingle comes again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_runs(batch):
                tokens, owner, offsets = _tokens(part, shingle)
                tokens = tokens.astype(np.uint32)  # half of each hash tells the few hundred shingles of a passage apart
                order, same = in_order(tokens | owner.astype(np.uint64) << np.uint64(32))
                following = np.full(len(tokens), len(tokens))  # where a shingle of a text comes again
                following[order[:-1][same]] = order[1:][same]
                wanted = part.column("wanted")
                text = np.repeat(np.arange(part.num_rows), wanted.value_lengths().to_numpy())
                flat = wanted.flatten()
                block, place, low, high = (flat.field(c).to_numpy() for c in ("block", "place", "low", "high"))
                order = np.lexsort((low, place, block, text))
                text, block, place, low, high = (c[order] for c in (text, block, place, low, high))
                again = (text[1:] == text[:-1]) & (block[1:] == block[:-1]) & (place[1:] == place[:-1])
                both, final = np.r_[False, again], ~np.r_[again, False]
                begin = offsets[text] + (place >> 18)
                size = (place >> 4 & 127) + length
                rows = np.flatnonzero(final & (begin + size <= offsets[text + 1]))
                node = part.column("node").to_numpy()
                for at in range(0, len(rows), ROWS_AT_ONCE):
                    some = rows[at : at + ROWS_AT_ONCE]
                    ends = np.r_[0, np.cumsum(4 * size[some])].astype(np.int32)
                    at_places = _ragged(begin[some], size[some])
                    cut = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(ends), pa.py_buffer(tokens[at_places])])
                    inner = following[at_places] < np.repeat((begin + size)[some], size[some])
                    repeats = np.logical_or.reduceat(inner, ends[:-1] // 4) if len(some) else inner
                    columns = [block[some], node[text[some]], place[some], low[some], high[some], both[some], repeats]
                    columns = [pa.array(c) for c in columns]
                    yield pa.RecordBatch.from_arrays([*columns, cut], names=[*BLOCK_COLUMNS, "tokens"])

    return giving_back(run)


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values of a short list; np.unique hashes, which costs more on some dozens of numbers."""
    x = np.sort(x)
    fresh = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=fresh[1:])
    return x[fresh]


def in_common(x: np.ndarray, y: np.ndarray) -> int:
    """Common values of two lists without repeats."""
    both = np.sort(np.concatenate([x, y]))
    return int((both[1:] == both[:-1]).sum())


def common_in_windows(i: np.ndarray, j: np.ndarray, begins: np.ndarray, starts: np.ndarray, of, length: int) -> np.ndarray:
    """Shingles that both sides have in each window of aligned pieces, from the places i and j of the common ones.

    Piece ``of`` has ``starts`` windows, which are counted from ``begins`` on; a shingle counts in the windows
    that hold both of its places.
    """
    low = np.maximum(np.maximum(i, j) - length + 1, 0)
    high = np.minimum(np.minimum(i, j), starts[of] - 1)
    inside = low <= high
    base = np.broadcast_to(begins[of], low.shape)[inside]
    size = int(starts.sum()) + 1
    return np.cumsum(np.bincount(base + low[inside], minlength=size) - np.bincount(base + high[inside] + 1, minlength=size))[:-1]


def alike_windows(x: np.ndarray, y: np.ndarray, length: int, percent: int) -> np.ndarray:
    """For every start, whether the windows of two aligned pieces are similar; shingles may come again."""
    at = np.arange(len(x))
    starts = len(x) - length + 1
    if len(x) <= DENSE:
        begins = np.arange(starts)
        inside = (at[:, None] >= begins) & (at[:, None] < begins + length)

        def news(z: np.ndarray) -> np.ndarray:
            """Per place and start, whether the shingle comes first there in the window."""
            order = np.argsort(z, kind="stable")
            again = z[order[1:]] == z[order[:-1]]
            before = np.full(len(z), -1)
            before[order[1:][again]] = order[:-1][again]
            return inside & (before[:, None] < begins)

        of_x, of_y = news(x), news(y)
        met = (x[:, None] == y).astype(np.float32) @ of_y.astype(np.float32) > 0
        common = (of_x & met).sum(axis=0)
        return (common > 0) & (100 * common >= percent * (of_x.sum(axis=0) + of_y.sum(axis=0) - common))
    low, high = np.maximum(at - length + 1, 0), np.minimum(at, starts - 1)
    own, their = _regions(x, low, high, 1), _regions(y, low, high, 1)  # the windows that hold a shingle, in runs
    both = _regions(*(np.concatenate(pair) for pair in zip(own, their)), 2)

    def per_window(runs: tuple[np.ndarray, ...]) -> np.ndarray:
        opened, closed = (np.bincount(edge, minlength=starts + 1) for edge in (runs[1], runs[2] + 1))
        return np.cumsum(opened - closed)[:-1]

    common = per_window(both)
    return (common > 0) & (100 * common >= percent * (per_window(own) + per_window(their) - common))


def in_order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, again): places by key, equal keys by place, and whether each but the first has the key of the one before.

    A plain sort is several times faster than a stable one, and few keys come again.
    """
    order = np.argsort(keys)
    again = keys[order][1:] == keys[order][:-1]
    rows = np.flatnonzero(np.r_[False, again] | np.r_[again, False])
    some = order[rows]
    order[rows] = some[np.lexsort((some, keys[some]))]
    return order, again


def verified_parts(x: np.ndarray, y: np.ndarray, length: int, percent: int) -> list[tuple[int, int]]:
    """Parts of two aligned passages that are similar: the whole, or else the union of similar windows."""
    n = min(len(x), len(y))
    if n < length:
        return []
    x, y = x[:n], y[:n]
    if np.array_equal(x, y):
        return [(0, n)]
    own, their = distinct(x), distinct(y)
    common = in_common(own, their)
    if common > 0 and 100 * common >= percent * (len(own) + len(their) - common):
        return [(0, n)]
    if len(own) == len(their) == n:
        # Without repeats, the places of a shingle tell the windows in which it is common.
        at = np.minimum(np.searchsorted(their, x), n - 1)
        i = np.flatnonzero(their[at] == x)
        common = common_in_windows(i, np.argsort(y)[at[i]], np.zeros(1, np.int64), np.array([n - length + 1]), 0, length)
        ok = 100 * common >= percent * (2 * length - common)
    else:
        ok = alike_windows(x, y, length, percent)
    edges = np.flatnonzero(np.diff(np.r_[False, ok, False]))
    parts: list[tuple[int, int]] = []
    for s, e in zip(edges[::2].tolist(), (edges[1::2] - 1 + length).tolist()):
        if parts and s <= parts[-1][1]:
            parts[-1] = (parts[-1][0], e)
        else:
            parts.append((s, e))
    return parts


def _verified(length: int, percent: int):
    names = ["node", "start", "stop", "other"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for node, start, other, other_start, x, y in zip(*(batch.column(i).to_pylist() for i in range(6))):
                for s, e in verified_parts(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), length, percent):
                    out.append((node, start + s, start + e, other))
                    out.append((other, other_start + s, other_start + e, node))
            columns = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return giving_back(run)


def _paired_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places where windows of two functions overlap, with a key made of both minima; all windows of a document are adjacent."""
    for table in whole_groups(batches, "node"):
        node, key, place = (table.column(c).to_numpy() for c in ("node", "key", "place"))
        first = place >> 18
        centre, last, function = first + (place >> 11 & 127), first + (place >> 4 & 127), place & 15
        base = np.cumsum(np.r_[False, node[1:] != node[:-1]]) * (int(last.max()) + 2)
        own = []
        for f in range(FUNCTIONS):
            rows = np.flatnonzero(function == f)
            own.append(rows[np.argsort((base + first)[rows], kind="stable")])
        for number, (f, g) in enumerate(itertools.combinations(range(FUNCTIONS), 2)):
            x, y = own[f], own[g]
            low = np.searchsorted((base + last)[y], (base + first)[x])
            many = np.searchsorted((base + first)[y], (base + last)[x], side="right") - low
            i = np.repeat(x, many)
            j = y[np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())]
            # The least shingle may stand before the place where it comes again; then the place begins with it.
            start = np.minimum(np.maximum(first[i], first[j]), centre[i])
            stop = np.minimum(last[i], last[j])
            both = mixed(key[i].view(np.uint64) ^ mixed(key[j].view(np.uint64) + np.uint64(number + 1)))
            code = (start << 18) | ((centre[i] - start) << 11) | ((stop - start) << 4) | number
            yield pa.RecordBatch.from_arrays(
                [pa.array(both.view(np.int64)), pa.array(node[i]), pa.array(code)], names=["key", "node", "place"]
            )


def _open_windows(length: int):
    """Windows with starts, low to high, in no verified passage; spans have place -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "node"):
            node, key, place, start, stop = (table.column(c).to_numpy() for c in ("node", "key", "place", "start", "stop"))
            begin = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            own = place >= 0
            low = np.where(own, place >> 18, start)
            high = np.where(own, low + (place >> 4 & 127), stop - length)
            room = np.maximum.reduceat(high, begin) + 2
            base = np.repeat(np.r_[0, np.cumsum(room)[:-1]], np.diff(np.r_[begin, len(node)]))

            def cover(rows: np.ndarray) -> np.ndarray:
                step = np.bincount((base + low)[rows], minlength=room.sum()) - np.bincount((base + high)[rows] + 1, minlength=room.sum())
                return np.cumsum(step)

            starts = np.flatnonzero((cover(own) > 0) & (cover(~own) == 0))
            first = np.searchsorted(starts, base + low)
            last = np.searchsorted(starts, base + high, side="right") - 1
            rows = np.flatnonzero(own & (first <= last))
            low, high = starts[first[rows]] - base[rows], starts[last[rows]] - base[rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (key[rows], node[rows], place[rows], low, high)], names=["key", "node", "place", "low", "high"]
            )

    return giving_back(run)


def _may_be_similar(own, news, kinds, theirs, inside, their_kinds, exact, length: int, percent: int) -> np.ndarray:
    """Rows of ``theirs``, aligned with ``own`` where ``inside``, that verified_parts may accept.

    news(start, place): the first places of shingles in the window of a start; kinds: distinct shingles per start;
    exact: neither side repeats a shingle.
    """
    known = distinct(own)
    of_own = np.searchsorted(known, own)
    at = np.minimum(np.searchsorted(known, theirs), len(known) - 1)
    hit = inside & (known[at] == theirs)
    met = np.zeros((len(theirs), len(known)), bool)
    met[np.broadcast_to(np.arange(len(theirs))[:, None], hit.shape)[hit], at[hit]] = True
    common = np.rint(met[:, of_own].astype(np.float32) @ news.T.astype(np.float32)).astype(np.int64)
    whole = inside[:, : len(kinds)] & inside[:, length - 1 :]
    close = (whole & ((100 + percent) * common >= percent * (kinds + their_kinds))).any(axis=1)
    wide = np.where(exact, 2 * inside.sum(axis=1), (whole * kinds).max(axis=1) + (whole * their_kinds).max(axis=1))
    return close | ((100 + percent) * met.sum(axis=1) >= percent * wide)


def _ragged(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places begins[i] to begins[i] + sizes[i] of every i in turn."""
    ends = np.cumsum(sizes)
    return np.repeat(begins - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


@dataclass
class _Members:
    """The windows of some blocks, one row each; ``looks`` marks those that look for partners from start low to high."""

    node: np.ndarray
    group: np.ndarray
    looks: np.ndarray
    first: np.ndarray
    centre: np.ndarray
    last: np.ndarray
    low: np.ndarray
    high: np.ndarray
    tokens: np.ndarray
    offsets: np.ndarray
    repeats: np.ndarray
    bits: np.ndarray
    #: The row of each window in ``fine``, the masks of FINE_BITS.
    held: np.ndarray
    fine: np.ndarray

    def pairs(self, looking: np.ndarray, length: int, percent: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(x, y, lo, hi, may) of looking windows and the ones their masks allow; all pairs of a window come together.

        ``may`` are the most shingles that both can share, lo to hi the starts of x that y has too.
        """
        needed, fewest = int(least_overlap(np.int64(length), np.int64(length), percent)), -(-percent * length // 100)
        theirs = np.flatnonzero(~self.looks)
        of_group = np.searchsorted(self.group[theirs], np.arange(self.group[-1] + 2))
        many = np.diff(of_group)[self.group[looking]]
        step, at = np.r_[0, np.cumsum(many)], 0
        while at < len(looking):
            stop = max(at + 1, int(np.searchsorted(step, step[at] + PAIRS_AT_ONCE, side="right")) - 1)
            some, count, at = looking[at:stop], many[at:stop], stop
            wide = self.high[some] - self.low[some] + length
            mask = np.zeros((len(some), 256), bool)
            own = self.tokens[_ragged(self.offsets[some] + self.low[some] - self.first[some], wide)]
            mask[np.repeat(np.arange(len(some)), wide), (own & np.uint32(255)).astype(np.int64)] = True
            mask = np.packbits(mask, axis=1).view(np.uint64)
            i = np.repeat(np.arange(len(some)), count)
            y, x = theirs[_ragged(of_group[self.group[some]], count)], some[i]
            shift = self.centre[y] - self.centre[x]
            lo, hi = np.maximum(self.low[x], self.first[y] - shift), np.minimum(self.high[x], self.last[y] - shift)
            may = wide[i] - np.bitwise_count(mask[i] & ~self.bits[y]).sum(axis=1, dtype=np.int64)
            need = np.where(self.repeats[x], 0, np.where(self.repeats[y], fewest, needed))
            ok = np.flatnonzero((self.node[y] != self.node[x]) & (lo <= hi) & (may >= need))
            ok = ok[np.lexsort((-may[ok], i[ok]))]
            yield x[ok], y[ok], lo[ok], hi[ok], may[ok]

    def may_be_similar(self, x, y, lo, hi, length: int, percent: int) -> np.ndarray:
        """Pairs without a repeated shingle that have a window, or a whole piece, with enough shingles in the fine mask of the other side."""
        wide, starts = hi - lo + length, hi - lo + 1
        mine = self.tokens[_ragged(self.offsets[x] + lo - self.first[x], wide)]
        hit = self.fine[np.repeat(self.held[y], wide), (mine & np.uint32(FINE_BITS - 1)).astype(np.int64)]
        total, begin = np.r_[0, np.cumsum(hit)], np.cumsum(wide) - wide
        at = _ragged(begin, starts)
        best = np.maximum.reduceat(total[at + length] - total[at], np.cumsum(starts) - starts) if len(x) else begin
        whole = total[begin + wide] - total[begin]
        return (100 * best >= percent * (2 * length - best)) | (100 * whole >= percent * (2 * wide - whole))

    def side_by_side(self, x, y, lo, hi, length: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """(pair, start): all similar windows, or pieces that are similar as a whole, of pairs without a repeated shingle."""
        wide, starts = hi - lo + length, hi - lo + 1
        pair = np.repeat(np.arange(len(x)), wide)
        shift = self.centre[y] - self.centre[x]
        mine = self.tokens[_ragged(self.offsets[x] + lo - self.first[x], wide)]
        other = self.tokens[_ragged(self.offsets[y] + lo + shift - self.first[y], wide)]
        keys = pair.astype(np.uint64) << np.uint64(32)
        both = np.concatenate([keys | mine, keys | other])
        order = np.argsort(both)  # a common shingle is a neighbour of itself
        met = np.flatnonzero(both[order][1:] == both[order][:-1])
        i, j = np.minimum(order[met], order[met + 1]), np.maximum(order[met], order[met + 1]) - len(pair)
        of, begin = pair[i], np.cumsum(wide) - wide
        common = common_in_windows(i - begin[of], j - begin[of], np.cumsum(starts) - starts, starts, of, length)
        shared = np.bincount(of, minlength=len(x))
        good = 100 * common >= percent * (2 * length - common)
        good |= np.repeat(100 * shared >= percent * (2 * wide - shared), starts)
        return np.repeat(np.arange(len(x)), starts)[good], _ragged(lo, starts)[good]


def _well_known(m: _Members, n: np.ndarray, crowded: np.ndarray, length: int, percent: int) -> np.ndarray:
    """Looking windows of the ``crowded`` blocks of whose shingles other documents of the block have enough for a similar window."""
    good = np.zeros(len(n), bool)
    rows = np.flatnonzero(crowded[m.group])
    looking = rows[m.looks[rows]]
    if not len(looking):
        return good
    at = _ragged(m.offsets[rows], n[rows])
    row = np.repeat(rows, n[rows])
    mark = m.tokens[at] | m.group[row].astype(np.uint64) << np.uint64(32)
    theirs, mine = np.flatnonzero(~m.looks[row]), np.flatnonzero(m.looks[row])
    theirs = theirs[np.argsort(mark[theirs])]
    opens = np.flatnonzero(np.r_[True, mark[theirs][1:] != mark[theirs][:-1]])
    marks, nodes = mark[theirs[opens]], m.node[row[theirs]]
    least, most = np.minimum.reduceat(nodes, opens), np.maximum.reduceat(nodes, opens)
    found = np.minimum(np.searchsorted(marks, mark[mine]), len(marks) - 1)
    own = m.node[row[mine]]
    known = (marks[found] == mark[mine]) & ((least[found] != own) | (most[found] != own))
    total = np.r_[0, np.cumsum(known)]  # over the looking windows one after the other
    begin = np.cumsum(n[looking]) - n[looking]
    starts = (m.high - m.low + 1)[looking]
    at = _ragged(begin + (m.low - m.first)[looking], starts)
    most_known = np.maximum.reduceat(total[at + length] - total[at], np.cumsum(starts) - starts)
    good[looking] = most_known >= -(-percent * length // 100)
    return good


def _met_in_blocks(length: int, percent: int):
    """Verified (node, start, stop, other, shift) of the windows that look (low >= 0) in every block against the other ones."""
    names = ["node", "start", "stop", "other", "shift"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "block"):
            both = table.column("both").to_numpy()
            copies = np.repeat(np.arange(len(both)), 1 + both)
            columns = (table.column(c).to_numpy()[copies] for c in BLOCK_COLUMNS if c != "both")
            block, node, place, low, high, repeats = columns
            low[1:][copies[1:] == copies[:-1]] = -1  # the second of two is looked at
            cuts = table.column("tokens").combine_chunks().cast(pa.large_binary())
            ends = np.frombuffer(cuts.buffers()[1], np.int64)[cuts.offset : cuts.offset + len(cuts) + 1]
            tokens = np.frombuffer(cuts.buffers()[2], np.uint32, (ends[-1] - ends[0]) // 4, ends[0])
            ends = (ends - ends[0]) // 4
            offsets, n = ends[copies], np.diff(ends)[copies]
            begin = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            end = np.r_[begin[1:], len(block)]
            group = np.repeat(np.arange(len(begin)), end - begin)
            first = place >> 18
            centre = first + (place >> 11 & 127)
            last = first + (place >> 4 & 127)
            looks = low >= 0
            if not looks.any() or looks.all():
                continue
            row = np.repeat(np.arange(len(both)), np.diff(ends))
            fine = np.zeros((len(both), FINE_BITS), bool)
            fine[row, (tokens & np.uint32(FINE_BITS - 1)).astype(np.int64)] = True
            bits = fine.reshape(len(both), -1, 256).any(axis=1)
            bits = np.packbits(bits, axis=1).view(np.uint64)[copies]
            # How far back a shingle stood before, and the distinct shingles of the window at every place.
            back, kinds = np.full(len(tokens), length), np.full(len(tokens), length)
            if repeats.any():
                some = np.zeros(len(both), bool)
                some[copies[repeats]] = True
                some = np.flatnonzero(some[row])
                order, again = in_order(tokens[some] | row[some].astype(np.uint64) << np.uint64(32))
                order = some[order]
                back[order[1:][again]] = np.minimum(order[1:][again] - order[:-1][again], length)
                at = np.arange(len(tokens))
                kinds = np.bincount(np.maximum(at - back + 1, 0), minlength=len(tokens) + 1) - np.bincount(at + 1, minlength=len(tokens) + 1)
                kinds = np.cumsum(kinds)
            members = _Members(node, group, looks, first, centre, last, low, high, tokens, offsets, repeats, bits, copies, fine)
            looking = np.bincount(group, looks)
            crowded = looking * (end - begin - looking) > CROWDED * (end - begin)
            looking = np.flatnonzero(looks & (~crowded[group] | repeats | _well_known(members, n, crowded, length, percent)))
            out = []
            for pairs in members.pairs(looking, length, percent):
                for piece in _by_window(pairs, SIDE_BY_SIDE):
                    out += _partners(members, piece, back, kinds, length, percent)
            columns = list(zip(*out)) or [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return giving_back(run)


def _by_window(pairs: tuple[np.ndarray, ...], most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """About ``most`` pairs at a time, all those of a looking window together."""
    x = pairs[0]
    ends = np.r_[np.flatnonzero(x[1:] != x[:-1]) + 1, len(x)] if len(x) else np.zeros(0, np.int64)
    at = 0
    while at < len(x):
        stop = int(ends[min(np.searchsorted(ends, at + most), len(ends) - 1)])
        yield tuple(c[at:stop] for c in pairs)
        at = stop


def _partners(m: _Members, pairs: tuple[np.ndarray, ...], back, kinds, length: int, percent: int) -> list[tuple]:
    """(node, start, stop, other, shift) that cover all starts of the looking windows that have a partner."""
    x, y, lo, hi, may = pairs
    shift = m.centre[y] - m.centre[x]
    plain = np.flatnonzero(~(m.repeats[x] | m.repeats[y]))
    plain = plain[m.may_be_similar(x[plain], y[plain], lo[plain], hi[plain], length, percent)]
    of, start = m.side_by_side(x[plain], y[plain], lo[plain], hi[plain], length, percent)
    of = plain[of]
    # The best partner of every start, as runs of starts.
    fresh = np.cumsum(np.r_[True, x[1:] != x[:-1]]) - 1
    wide = np.int64((m.high - m.low)[x].max() + 1)
    place, best = np.unique(fresh[of] * wide + start - m.low[x[of]], return_index=True)
    order = np.lexsort((start[best], of[best]))
    of, start = of[best][order], start[best][order]
    begin = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (start[1:] != start[:-1] + 1)]) if len(of) else of
    final = np.r_[begin[1:], len(of)] - 1 if len(of) else of
    p = of[begin]
    out = list(zip(m.node[x[p]].tolist(), start[begin].tolist(), (start[final] + length).tolist(), m.node[y[p]].tolist(), shift[p].tolist()))
    met = np.bincount(place // wide, minlength=fresh[-1] + 1)
    rest = np.flatnonzero((m.repeats[x] | m.repeats[y]) & (met[fresh] < (m.high - m.low + 1)[x]))
    for rows in np.split(rest, np.flatnonzero(np.diff(fresh[rest])) + 1) if len(rest) else []:
        w, others = int(x[rows[0]]), y[rows]
        a, z = m.low[w], m.high[w]
        left = np.ones(z - a + 1, bool)
        left[place[np.searchsorted(place, fresh[rows[0]] * wide) : np.searchsorted(place, (fresh[rows[0]] + 1) * wide)] % wide] = False
        out += _one_by_one(m, w, others, lo[rows], hi[rows], shift[rows], may[rows], left, back, kinds, length, percent)
    return out


def _one_by_one(m: _Members, x: int, other, lo, hi, shift, may, left, back, kinds, length: int, percent: int) -> list[tuple]:
    """Verified passages of one window with the other ones until no start is ``left``."""
    a, z = m.low[x], m.high[x]
    from_ = m.offsets[x] + a - m.first[x] + np.arange(z - a + 1)
    own = m.tokens[from_[0] : from_[-1] + length]
    cell, start = np.arange(len(own)), np.arange(z - a + 1)
    inside = (cell >= lo[:, None] - a) & (cell < hi[:, None] - a + length)
    to = (m.offsets[other] - m.first[other] + shift + a)[:, None] + cell
    theirs_at = np.where(inside, to, 0)
    news = (cell >= start[:, None]) & (cell < start[:, None] + length) & (cell - back[from_[0] + cell] < start[:, None])
    exact = ~m.repeats[x] & ~m.repeats[other]
    fits = np.flatnonzero(_may_be_similar(
        own, news, kinds[from_], m.tokens[theirs_at], inside, kinds[theirs_at[:, : z - a + 1]], exact, length, percent
    ))
    out = []
    for y in fits[np.argsort(-may[fits], kind="stable")].tolist():
        if not left[lo[y] - a : hi[y] - a + 1].any():
            continue
        their = other[y]
        at = m.offsets[their] + lo[y] + shift[y] - m.first[their]
        wide = hi[y] - lo[y] + length
        for p, q in verified_parts(own[lo[y] - a :][:wide], m.tokens[at : at + wide], length, percent):
            out.append((m.node[x], lo[y] + p, lo[y] + q, m.node[their], shift[y]))
            left[lo[y] + p - a : lo[y] + q - length + 1 - a] = False
        if not left.any():
            break
    return out


def _fields(place):
    """(first, centre, last) of a place."""
    start = F.shiftright(place, 18)
    return start, start + F.shiftright(place, 11).bitwiseAND(127), start + F.shiftright(place, 4).bitwiseAND(127)


def _sliced(rows: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, start, stop, tokens) of the distinct ``wanted(node, start, stop)``."""
    wanted = settled(wanted.distinct())
    few = wanted.count() <= BROADCAST_SPANS
    of_node = wanted.groupBy("node").agg(F.collect_list(F.struct("start", "stop")).alias("wanted"))
    texts = rows.join(F.broadcast(of_node) if few else of_node, "node")
    slices = settled(texts.mapInArrow(_slices(shingle), "node long, start long, stop long, tokens binary"))
    dropped(wanted)
    return slices


def _verified_spans(rows: DataFrame, passages: DataFrame, shingle: int, length: int, percent: int) -> DataFrame:
    """(node, start, stop, other) of the similar parts of ``passages``, each once, for both sides of each."""
    wanted = passages.select("node", "start", "stop").union(passages.select("other", "other_start", "other_stop"))
    slices = _sliced(rows, wanted, shingle)
    theirs = slices.select(
        F.col("node").alias("other"), F.col("start").alias("other_start"), F.col("stop").alias("other_stop"),
        F.col("tokens").alias("other_tokens"),
    )
    both = passages.join(slices, ["node", "start", "stop"]).join(theirs, ["other", "other_start", "other_stop"])
    both = both.select("node", "start", "other", "other_start", "tokens", "other_tokens")
    found = both.mapInArrow(_verified(length, percent), "node long, start long, stop long, other long")
    found = settled(found.distinct())
    dropped(passages, slices)
    return found


def _merged(spans: DataFrame) -> DataFrame:
    """(node, start, stop, other): spans of a document that overlap or touch are one."""
    spans = spans.groupBy("node", "start", "stop").agg(F.min("other").alias("other"))
    order = Window.partitionBy("node").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", (F.coalesce(reach, F.lit(-1)) < F.col("start")).cast("int"))
    spans = spans.withColumn("number", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return spans.groupBy("node", "number").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("other").alias("other")
    ).drop("number")


def _with_partner(windows: DataFrame) -> DataFrame:
    """The written ``windows`` whose key another document has too, with the smallest and the largest document of the key."""
    ends = windows.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high")
    ends = settled(ends)
    shared = settled(windows.join(ends, "key"))
    dropped(windows, ends)
    return shared


def _rest_of_groups(
    rows: DataFrame, shared: DataFrame, spans: DataFrame, shingle: int, length: int, percent: int
) -> DataFrame | None:
    """(node, start, stop, other) found where the places that ``spans`` leaves open meet all places with their key; None: none is open."""
    none = F.lit(-1).cast("long")
    paired = shared.select("node", "key", "place").repartition("node").sortWithinPartitions("node")
    windows, shared = shared, settled(paired.mapInArrow(giving_back(_paired_windows), WINDOW_SCHEMA))
    dropped(windows)
    known = _merged(spans).select("node", none.alias("key"), none.alias("place"), "start", "stop")
    both = shared.select("node", "key", "place", none.alias("start"), none.alias("stop")).unionByName(known)
    both = both.repartition("node").sortWithinPartitions("node")
    opened = settled(both.mapInArrow(_open_windows(length), "key long, node long, place long, low long, high long"))
    looking = settled(opened.groupBy("key").agg(F.count("*").alias("looking")))
    groups = shared.join(looking, "key").groupBy("key").agg(
        F.count("*").alias("c"), F.first("looking").alias("looking"), F.min("node").alias("low"), F.max("node").alias("high")
    )
    groups = settled(groups.filter("low <> high").select(
        "key", F.ceil(F.col("c") / BLOCK_ROWS).alias("parts"), F.ceil(F.col("looking") / BLOCK_ROWS).alias("turns")
    ))
    if groups.isEmpty():
        return None
    dropped(looking)
    members = shared.select("key", "node", "place").join(groups, "key")

    def dealt(windows: DataFrame, parts: str, others: str, *block: str) -> DataFrame:
        part = F.pmod(F.xxhash64("node", "place"), F.col(parts))
        windows = windows.withColumns({parts: part, others: F.explode(F.sequence(F.lit(0), F.col(others) - 1))})
        return windows.select("node", F.struct(F.xxhash64("key", *block).alias("block"), "place", "low", "high").alias("row"))

    block = ("parts", "turns")
    theirs = dealt(members.withColumns({"low": none, "high": none}), "parts", "turns", *block)
    asked = dealt(opened.join(groups, "key"), "turns", "parts", *block).unionByName(theirs)
    asked = settled(asked.groupBy("node").agg(F.collect_list("row").alias("wanted")))
    dropped(shared, opened, groups)
    blocks = rows.join(asked, "node").mapInArrow(_block_rows(shingle, length), BLOCK_SCHEMA)
    blocks = blocks.repartition("block").sortWithinPartitions("block")
    found = settled(
        blocks.mapInArrow(_met_in_blocks(length, percent), "node long, start long, stop long, other long, shift long")
    )
    dropped(asked)
    shift = F.col("shift")
    spans = found.select("node", "start", "stop", "other").union(
        found.select("other", F.col("start") + shift, F.col("stop") + shift, "node")
    )
    # Windows of one alignment are a passage as a whole where it is similar as a whole.
    joined = found.groupBy("node", "other", "shift").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("c"))
    joined = joined.filter("c > 1").select(
        "node", "start", "stop", "other", (F.col("start") + shift).alias("other_start"), (F.col("stop") + shift).alias("other_stop")
    )
    return spans.union(_verified_spans(rows, settled(joined), shingle, length, percent))


def repeated_passages(
    docs: DataFrame, least_words: int = LEAST_WORDS, shingle: int = SHINGLE, percent: int = PERCENT,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(doc_id, word_start, word_end, n_words, with_doc_id): maximal passages with a near duplicate in another document.

    Words are split at ASCII white space and A-Z are lowered; word_end is exclusive. A passage has at least
    ``least_words`` words, and its shingle set a Jaccard similarity of ``percent`` or more with a passage
    of with_doc_id, the smallest such document found. Shorter, empty and null texts have none. Rows that
    share an id are one document; rows without an id are known by their text and give null ids. Other
    columns are not looked at; an empty table gives no rows.
    """
    length = least_words - shingle + 1
    if not 1 <= length < 128:
        raise ValueError("passages of shingle to shingle + 126 words")
    nameless = F.lit(NAMELESS) + F.shiftrightunsigned(F.xxhash64(text), 2)
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), nameless).alias("node"), F.col(text).alias("text"))
    shared = _with_partner(settled(rows.mapInArrow(_windows(shingle, length), WINDOW_SCHEMA)))
    partners = shared.groupBy("key").agg(
        F.min(F.when(F.col("node") == F.col("low"), F.col("place"))).alias("low_place"),
        F.min(F.when(F.col("node") == F.col("high"), F.col("place"))).alias("high_place"),
    )
    partners = settled(partners)
    met = shared.join(partners, "key")
    both_ends = F.array(
        F.struct(F.col("low").alias("other"), F.col("low_place").alias("theirs")),
        F.struct(F.col("high").alias("other"), F.col("high_place").alias("theirs")),
    )

    first, centre, last = _fields(F.col("place"))
    their_first, their_centre, their_last = _fields(F.col("theirs"))
    shift = their_centre - centre
    # The first window of the smallest document is met by all others; only its repeats look for a partner.
    looking = met.filter("node <> low OR place <> low_place")
    pairs = looking.select("node", "place", F.inline(both_ends)).filter("node <> other").select(
        "node", "other", shift.alias("shift"),
        F.greatest(first, their_first - shift).alias("low"), F.least(last, their_last - shift).alias("high"),
        F.col("place").bitwiseAND(15).alias("function"),
    )
    # All edges of a document start from its own windows, so its length bounds them.
    pairs = pairs.filter("low <= high")
    pairs = pairs.repartition("node").sortWithinPartitions("node")
    passages = settled(
        pairs.mapInArrow(
            _passages(length), "node long, start long, stop long, other long, other_start long, other_stop long"
        )
    )
    dropped(partners)
    spans = _verified_spans(rows, passages, shingle, length, percent)
    rest = _rest_of_groups(rows, shared, spans, shingle, length, percent)
    merged = _merged(spans if rest is None else spans.union(rest)).select(
        "node", F.col("start").alias("word_start"), (F.col("stop") + shingle - 1).alias("word_end"), "other"
    )

    def named(column: str):
        return F.when(F.col(column) < NAMELESS, F.col(column))

    return merged.select(
        named("node").alias("doc_id"), "word_start", "word_end", (F.col("word_end") - F.col("word_start")).alias("n_words"),
        named("other").alias("with_doc_id"),
    )
