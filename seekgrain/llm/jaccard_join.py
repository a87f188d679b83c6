"""N-gram Jaccard self-join with signature trees, up to connected components.

1. Every text becomes a sorted set of shingle hashes. Equal sets are one class with one representative.
2. Two sets that reach the threshold share one of their first n - ceil(t n) + 1 shingles in any common
   order, so every shingle of such a prefix is a bucket and each link lies in one. The order is by hash,
   with the most frequent shingles last, which keeps passages that many documents share out of prefixes.
   Buckets with the same members are one.
3. In a bucket (of blocks of bounded size) a tree is built over the sets' bitmaps: a node holds the OR of
   the bitmaps below it and their range of sizes. Pairs of nodes are walked from the root down; a pair
   whose greatest possible overlap is too small is dropped. The surviving pairs give a spanning forest.
4. Forest edges are checked on the whole sets. Where one fails and the forest had left out other pairs,
   and between the blocks of a bucket that is more than one block, the bucket is joined once more on
   whole sets, skipping pairs that are known to be connected. So no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seekgrain.llm.common import components, counted_broadcast, giving_back, unused, written
from seekgrain.llm.shingles import mixed, shingle_sets, text_runs

#: A shingle in more prefixes than this is frequent; at most so many of them go last in the order.
FREQUENT, FREQUENT_MOST = 500, 1 << 16
BLOCK_ROWS = 2048
SMALL, LEAF = 16, 16
#: Bitmaps have 2 to the power of this many 64-bit words at least.
LEAST_CLASS = 3
#: Nodes of rows without an id start here.
NAMELESS = 1 << 62
SET_SCHEMA = "node long, n long, fp_a long, fp_b long, signature binary, prefix array<long>"


def least_overlap(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Common members that sets of sizes a and b need: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_sizes(n: np.ndarray, percent: int) -> np.ndarray:
    return np.where(n > 0, n + (-percent * n) // 100 + 1, 0)


def signature_words(n: np.ndarray) -> np.ndarray:
    """64-bit words of the bitmap of a set of size n: a power of two with 4 to 8 bits per member."""
    return 1 << np.maximum(np.ceil(np.log2(np.maximum(n, 1) / 16)), LEAST_CLASS).astype(np.int64)


def bitmaps(values: np.ndarray, owner: np.ndarray, rows: int, words: int) -> np.ndarray:
    """One bitmap per row; the low bits of a hash are its place, so OR-ing the halves gives the next smaller bitmap."""
    bits = np.zeros((rows, words * 64), dtype=bool)
    bits[owner, ((values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)).astype(np.int64) & (words * 64 - 1)] = True
    return np.packbits(bits, axis=1).view(np.uint64)


def signatures(values: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    out: list[bytes] = [b""] * (len(offsets) - 1)
    n = np.diff(offsets)
    words = signature_words(n)
    owner = np.repeat(np.arange(len(n)), n)
    for width in np.unique(words):
        rows = np.flatnonzero(words == width)
        for s in range(0, len(rows), max(1, (1 << 18) // int(width))):
            some = rows[s : s + max(1, (1 << 18) // int(width))]
            spot = np.full(len(n), -1)
            spot[some] = np.arange(len(some))
            mine = spot[owner] >= 0
            for row, bits in zip(some, bitmaps(values[mine], spot[owner[mine]], len(some), int(width))):
                out[row] = bits.tobytes()
    return out


class Bitmaps:
    """Bitmaps of different widths; rows are read at any common, smaller width."""

    def __init__(self, bodies: list[bytes]):
        self.words = np.array([len(b) // 8 for b in bodies], dtype=np.int64)
        self.spot = np.zeros(len(bodies), dtype=np.int64)
        self.tables: dict[int, np.ndarray] = {}
        for width in np.unique(self.words).tolist():
            rows = np.flatnonzero(self.words == width)
            self.spot[rows] = np.arange(len(rows))
            self.tables[width] = np.frombuffer(b"".join(bodies[r] for r in rows), dtype=np.uint64).reshape(-1, width)

    def at(self, rows: np.ndarray, width: int) -> np.ndarray:
        out = np.empty((len(rows), width), dtype=np.uint64)
        for own in np.unique(self.words[rows]).tolist():
            here = self.words[rows] == own
            table = self.tables[own][self.spot[rows[here]]]
            while table.shape[1] > width:
                half = table.shape[1] // 2
                table = table[:, :half] | table[:, half:]
            out[here] = table
        return out


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(values.view(np.int64)))


def _sets(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_runs(batch):
                values, offsets = shingle_sets(part.column("text"), width)
                n = np.diff(offsets)
                owner = np.repeat(np.arange(len(n)), n)
                scrambled = mixed(values)
                running = np.r_[np.uint64(0), np.cumsum(scrambled)]
                fp_a = running[offsets[1:]] - running[offsets[:-1]]
                running = np.r_[np.uint64(0), np.cumsum(mixed(scrambled ^ np.uint64(0x5851F42D4C957F2D)))]
                fp_b = running[offsets[1:]] - running[offsets[:-1]]
                first = prefix_sizes(n, percent)
                taken = values[np.arange(len(values)) - offsets[:-1][owner] < first[owner]]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("node"), pa.array(n), pa.array(fp_a.view(np.int64)), pa.array(fp_b.view(np.int64)),
                        pa.array(signatures(values, offsets), pa.binary()),
                        _lists(taken, first),
                    ],
                    names=["node", "n", "fp_a", "fp_b", "signature", "prefix"],
                )

    return giving_back(run)


def _moved_prefixes(width: int, percent: int, frequent):
    """For texts with a frequent shingle in their prefix, the shingles that come in when those go last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = frequent.value
        for batch in batches:
            for part in text_runs(batch):
                values, offsets = shingle_sets(part.column("text"), width)
                n = np.diff(offsets)
                first = prefix_sizes(n, percent)
                late = last[np.minimum(np.searchsorted(last, values), len(last) - 1)] == values
                owner = np.repeat(np.arange(len(n)), n)
                inside = np.arange(len(values)) - offsets[:-1][owner] < first[owner]
                running = np.r_[np.uint64(0), np.cumsum(mixed(values))]
                fp_a = (running[offsets[1:]] - running[offsets[:-1]]).view(np.int64)
                rows, added = np.unique(owner[late & inside]), []
                for row in rows:
                    own, hot = values[offsets[row] : offsets[row + 1]], late[offsets[row] : offsets[row + 1]]
                    ordered = np.r_[own[~hot], own[hot]][: first[row]]
                    stayed = int((~hot[: first[row]]).sum())
                    added.append(ordered[stayed:])
                total = np.concatenate(added) if added else np.zeros(0, np.uint64)
                sizes = np.array([len(a) for a in added], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("node").take(pa.array(rows)), pa.array(fp_a[rows]), _lists(total, sizes)], names=["node", "fp_a", "prefix"]
                )

    return giving_back(run)


class Forest:
    """Union-find over small integers."""

    def __init__(self, parent: np.ndarray):
        self.parent = parent

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True

    def roots(self) -> np.ndarray:
        parent = self.parent
        while True:
            up = parent[parent]
            if (up == parent).all():
                return parent
            parent = up


def possible(n: np.ndarray, bits: Bitmaps, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Pairs of sets whose bitmaps allow the overlap they need: a set bit that the other lacks is a shingle it lacks."""
    need = least_overlap(n[i], n[j], percent)
    ok = np.minimum(n[i], n[j]) >= need
    width = np.minimum(bits.words[i], bits.words[j])
    for w in np.unique(width[ok]).tolist():
        at = np.flatnonzero(ok & (width == w))
        for s in range(0, len(at), max(1, (1 << 21) // w)):
            some = at[s : s + max(1, (1 << 21) // w)]
            a, b = i[some], j[some]
            x, y = bits.at(a, w), bits.at(b, w)
            both = np.bitwise_count(x & y).sum(axis=1, dtype=np.int64)
            most_a = n[a] - (np.bitwise_count(x).sum(axis=1, dtype=np.int64) - both)
            most_b = n[b] - (np.bitwise_count(y).sum(axis=1, dtype=np.int64) - both)
            ok[some] = np.minimum(most_a, most_b) >= need[some]
    return ok


def tree_pairs(n: np.ndarray, bits: Bitmaps, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j that signature trees over rows ordered by size cannot rule out.

    One tree per bitmap width holds the rows of that width and the larger ones that are near enough in size.
    """
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for width in np.unique(bits.words).tolist():
        own = bits.words == width
        rows = np.flatnonzero(own | ((bits.words > width) & (percent * n <= 100 * n[own].max())))
        i, j = _one_tree(n[rows], bits.at(rows, width), percent)
        i, j = rows[i], rows[j]
        mine = np.minimum(bits.words[i], bits.words[j]) == width
        i, j = i[mine], j[mine]
        ok = possible(n, bits, i, j, percent)
        found.append((i[ok], j[ok]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _one_tree(n: np.ndarray, bits: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    spare = n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    at = np.arange(0, len(n), LEAF)
    levels = [tuple(f.reduceat(v, at, axis=0) for f, v in ((np.bitwise_or, bits), (np.minimum, n), (np.maximum, n), (np.maximum, spare)))]
    while len(levels[-1][1]) > 1:
        masks, low, high, extra = levels[-1]
        at = np.arange(0, len(low), 2)
        levels.append(tuple(f.reduceat(v, at, axis=0) for f, v in ((np.bitwise_or, masks), (np.minimum, low), (np.maximum, high), (np.maximum, extra))))
    a = b = np.zeros(1, dtype=np.int64)
    for depth in range(len(levels) - 1, -1, -1):
        masks, low, high, extra = levels[depth]
        if depth < len(levels) - 1:
            a, b = (2 * a[:, None] + [0, 0, 1, 1]).ravel(), (2 * b[:, None] + [0, 1, 0, 1]).ravel()
            inside = (a <= b) & (b < len(low))
            a, b = a[inside], b[inside]
        near = (100 * high[a] >= percent * low[b]) & (100 * high[b] >= percent * low[a])
        a, b = a[near], b[near]
        fits = np.zeros(len(a), dtype=bool)
        step = max(1, (1 << 20) // bits.shape[1])
        for s in range(0, len(a), step):
            x, y = a[s : s + step], b[s : s + step]
            shared = np.bitwise_count(masks[x] & masks[y]).sum(axis=1, dtype=np.int64) + np.minimum(extra[x], extra[y])
            fits[s : s + step] = shared >= least_overlap(low[x], low[y], percent)
        a, b = a[fits], b[fits]
    cell = np.arange(LEAF)
    i = (a[:, None, None] * LEAF + cell[None, :, None] + 0 * cell).ravel()
    j = (b[:, None, None] * LEAF + cell[None, None, :] + 0 * cell[None, :, None]).ravel()
    inside = (i < j) & (j < len(n))
    return i[inside], j[inside]


def spanning(rows: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Places of pairs (i < j) that make a spanning forest of them; each row's first pair is tried first."""
    forest, chosen = Forest(np.arange(rows)), []
    order = np.lexsort((i, j))
    firsts = order[np.r_[True, j[order][1:] != j[order][:-1]]] if len(order) else order
    left = order
    for turn in (firsts, None):
        if turn is None:
            roots = forest.roots()
            turn = left[roots[i[left]] != roots[j[left]]]
        chosen += [p for p in turn.tolist() if forest.join(int(i[p]), int(j[p]))]
    return np.array(chosen, dtype=np.int64)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups of equal, adjacent ``key`` values; batches are cut only between groups."""
    kept = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if kept is not None:
            table = pa.concat_tables([kept, table])
        keys = table.column(key).to_numpy()
        others = np.flatnonzero(keys != keys[-1])
        cut = int(others[-1]) + 1 if len(others) else 0
        kept = table.slice(cut)
        if cut:
            yield table.slice(0, cut)
    if kept is not None:
        yield kept


def _forest_edges(percent: int):
    """(block, a, b, more) of a spanning forest of the possible pairs of every block; more: pairs were left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "block"):
            block, node, n = (table.column(c).to_numpy() for c in ("block", "node", "n"))
            bits = Bitmaps(table.column("signature").to_pylist())
            starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            sizes = np.diff(np.r_[starts, len(block)])
            group = np.repeat(np.arange(len(starts)), sizes)
            small = (sizes <= SMALL)[group]
            left, right = [], []
            for d in range(1, min(SMALL, len(block))):
                at = np.flatnonzero((group[:-d] == group[d:]) & small[:-d])
                left.append(at), right.append(at + d)
            i = np.concatenate(left) if left else np.zeros(0, np.int64)
            j = np.concatenate(right) if right else np.zeros(0, np.int64)
            ok = possible(n, bits, i, j, percent)
            i, j = i[ok], j[ok]
            for g in np.flatnonzero(sizes > SMALL):
                s, e = starts[g], starts[g] + sizes[g]
                x, y = tree_pairs(n[s:e], Bitmaps(table.column("signature").slice(s, e - s).to_pylist()), percent)
                i, j = np.r_[i, x + s], np.r_[j, y + s]
            differ = node[i] != node[j]
            i, j = i[differ], j[differ]
            chosen = spanning(len(block), i, j)
            many = np.bincount(group[i], minlength=len(starts)) > np.bincount(group[i[chosen]], minlength=len(starts))
            a, b = node[i[chosen]], node[j[chosen]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(block[i[chosen]]), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(many[group[i[chosen]]])],
                names=["block", "a", "b", "more"],
            )

    return giving_back(run)


def _exact_edges(percent: int):
    """(a, b) links between different components of every block, on whole sets; components found on the way count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "block"):
            blocks = table.column("block").to_numpy()
            for s, e in _spans(blocks):
                part = table.slice(s, e - s)
                node, n, comp, side = (part.column(c).to_numpy() for c in ("node", "n", "component", "side"))
                members = [np.frombuffer(v, dtype=np.uint64) for v in part.column("members").to_pylist()]
                bits = Bitmaps(signatures(np.concatenate(members), np.r_[0, np.cumsum(n)]))
                i, j = tree_pairs(n, bits, percent)
                cross = (comp[i] != comp[j]) & ((side[i] != side[j]) | (side[i] == 2))
                i, j = i[cross], j[cross]
                _, first, index = np.unique(comp, return_index=True, return_inverse=True)
                forest = Forest(first[index])
                edges = []
                for x, y in zip(i.tolist(), j.tolist()):
                    if forest.root(x) != forest.root(y) and linked(members[x], members[y], percent):
                        forest.join(x, y)
                        edges.append((min(node[x], node[y]), max(node[x], node[y])))
                pairs = np.array(edges, dtype=np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return giving_back(run)


def _spans(keys: np.ndarray) -> list[tuple[int, int]]:
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return list(zip(starts.tolist(), np.r_[starts[1:], len(keys)].tolist()))


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common) and common > 0


def _checked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("left").to_pylist(), batch.column("right").to_pylist())
            ok = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in pairs]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], names=["a", "b", "linked"])

    return giving_back(run)


def _members(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_runs(batch):
                values, offsets = shingle_sets(part.column("text"), width)
                rows = [values[s:e].tobytes() for s, e in zip(offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(rows, pa.binary())], names=["node", "members"])

    return giving_back(run)


def one_of_equal_lists(blocks: DataFrame) -> DataFrame:
    """The blocks of ``blocks(block, node)`` with two nodes or more, one of those that have the same nodes."""
    lists = blocks.groupBy("block").agg(
        F.expr("bit_xor(xxhash64(node))").alias("x"), F.expr("bit_xor(xxhash64(node, 1))").alias("y"),
        F.count("*").alias("c"), F.min("node").alias("low"), F.max("node").alias("high"),
    )
    return lists.filter("low <> high").groupBy("x", "y", "c").agg(F.min("block").alias("block")).select("block")


def similar_components(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    Rows link when the Jaccard similarity of their sets of ``width``-word shingles is ``percent`` or more;
    component_id is the smallest id reachable. A text with fewer words is one shingle; null, empty and
    blank texts have none and link with nothing. Rows that share an id are one node. A row without an id is
    a node known by its text, and an id-less component has component_id null. Only the id and text columns
    are looked at; an empty table gives no rows.
    """
    spark = docs.sparkSession
    nameless = F.lit(NAMELESS) + F.shiftrightunsigned(F.xxhash64(text), 2)
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), nameless).alias("node"), F.col(text).alias("text"))
    sets = written(rows.mapInArrow(_sets(width, percent), SET_SCHEMA))
    real = sets.filter("n > 0")
    classes = real.groupBy("fp_a", "fp_b", "n").agg(F.min("node").alias("rep"), F.max("node").alias("most")).filter("rep <> most")
    copies = written(
        real.select("node", "fp_a", "fp_b", "n").join(written(classes), ["fp_a", "fp_b", "n"]).filter("node <> rep")
        .select("node", "fp_a", "rep").distinct()
    )
    few_copies = counted_broadcast(copies.select("node", "fp_a"))
    reps = real.join(few_copies, ["node", "fp_a"], "left_anti")
    posted = reps.select("node", F.explode("prefix").alias("token"))
    counts = posted.groupBy("token").agg(F.count("*").alias("c"), F.min("node").alias("low"), F.max("node").alias("high"))
    shared = written(counts.filter("low <> high").select("token", "c"))
    # A bounded list; it only decides the order of shingles, never the result.
    top = shared.filter(F.col("c") > FREQUENT).orderBy(F.desc("c"), "token").limit(FREQUENT_MOST).select("token").toArrow()
    keys = shared.select("token")
    if top.num_rows:
        last = np.sort(top.column("token").to_numpy().astype(np.int64).view(np.uint64))
        frequent = spark.sparkContext.broadcast(last)
        listed = F.broadcast(spark.createDataFrame(top))  # FREQUENT_MOST rows at most
        moved = rows.mapInArrow(_moved_prefixes(width, percent, frequent), "node long, fp_a long, prefix array<long>")
        moved = written(moved.join(few_copies, ["node", "fp_a"], "left_anti"))
        moved = moved.select("node", F.explode("prefix").alias("token"))
        posted = posted.join(listed, "token", "left_anti").unionByName(moved)
        keys = keys.join(listed, "token", "left_anti").union(moved.select("token")).distinct()
    members = written(posted.join(keys, "token"))
    lists = members.groupBy("token").agg(
        F.expr("bit_xor(xxhash64(node))").alias("x"), F.expr("bit_xor(xxhash64(node, 1))").alias("y"),
        F.count("*").alias("c"), F.min("node").alias("low"), F.max("node").alias("high"),
    )
    buckets = written(lists.filter("low <> high").groupBy("x", "y", "c").agg(F.min("token").alias("token")).select("token", "c"))
    inside = members.join(buckets, "token").withColumn("parts", F.ceil(F.col("c") / BLOCK_ROWS))
    inside = inside.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    inside = written(inside.select("token", "node", "part", "parts"))
    # In a block, rows that no other one is near enough in size cannot link; the nearest is next to them.
    by_size = Window.partitionBy("token", "part").orderBy("n", "node")
    sized = inside.join(reps.select("node", "n"), "node").select(
        "token", "part", "node", "n", F.lag("n").over(by_size).alias("below"), F.lead("n").over(by_size).alias("above")
    )
    close = (100 * F.col("below") >= percent * F.col("n")) | (100 * F.col("n") >= percent * F.col("above"))
    near = written(sized.filter(close).select(F.xxhash64("token", "part").alias("block"), "node"))
    near = near.join(one_of_equal_lists(near), "block", "left_semi")
    seen = near.join(reps.select("node", "n", "signature"), "node")
    forest = seen.repartition("block").sortWithinPartitions("block", "n").select("block", "node", "n", "signature")
    forest = written(forest.mapInArrow(_forest_edges(percent), "block long, a long, b long, more boolean"))
    pairs = written(forest.select("a", "b").distinct())
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    whole = rows.join(counted_broadcast(written(needed)), "node", "left_semi").mapInArrow(_members(width), "node long, members binary")
    whole = written(whole)
    tested = pairs.join(whole.select(F.col("node").alias("a"), F.col("members").alias("left")), "a")
    tested = tested.join(whole.select(F.col("node").alias("b"), F.col("members").alias("right")), "b").select("a", "b", "left", "right")
    tested = written(tested.mapInArrow(_checked(percent), "a long, b long, linked boolean").groupBy("a", "b").agg(F.max("linked").alias("linked")))
    edges = tested.filter("linked").select("a", "b").unionByName(copies.select(F.col("rep").alias("a"), F.col("node").alias("b")))
    labels = components(edges)
    failed = tested.filter(~F.col("linked")).select("a", "b")
    open_blocks = written(forest.filter("more").join(failed, ["a", "b"], "left_semi").select("block").distinct())
    big = inside.filter("parts > 1")
    if not (open_blocks.isEmpty() and big.isEmpty()):
        known = big.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        met = forest.join(open_blocks, "block", "left_semi").select("block", F.explode(F.array("a", "b")).alias("node"))
        met = written(met.distinct())
        met = met.join(one_of_equal_lists(met), "block", "left_semi")
        again = met.join(labels, "node", "left").select(
            "block", "node", F.coalesce("component", "node").alias("component"), F.lit(2).alias("side")
        )
        apart = again.groupBy("block").agg(F.min("component").alias("l"), F.max("component").alias("h")).filter("l <> h")
        again = again.join(apart.select("block"), "block", "left_semi")
        several = known.groupBy("token").agg(F.min("component").alias("l"), F.max("component").alias("h"))
        split = known.join(several.filter("l <> h").select("token"), "token", "left_semi")
        other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
        split = split.select("token", "node", "component", "part", other).filter("part <> other")
        split = split.select(
            F.xxhash64("token", F.least("part", "other"), F.greatest("part", "other")).alias("block"), "node", "component",
            (F.col("part") > F.col("other")).cast("int").alias("side"),
        )
        again = written(again.unionByName(split).distinct())
        wanted = counted_broadcast(written(again.select("node").distinct()))
        whole = written(rows.join(wanted, "node", "left_semi").mapInArrow(_members(width), "node long, members binary"))
        exact = again.join(whole, "node").withColumn("n", (F.octet_length("members") / 8).cast("long"))
        exact = exact.repartition("block").sortWithinPartitions("block", "n")
        more = exact.select("block", "node", "component", "side", "n", "members").mapInArrow(_exact_edges(percent), "a long, b long")
        labels = components(edges.unionByName(more))
    found = sets.select("node", "n").join(labels, "node", "left")
    component = F.coalesce("component", "node")
    return found.select(
        F.when(F.col("node") < NAMELESS, F.col("node")).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(component < NAMELESS, component).alias("component_id"),
    )


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that have the smallest id of their component, id-less rows last.

    Id and text together make a node here, so rows that share an id with different texts are judged apart,
    and equal ones, also id-less ones, stay or go together.
    """
    node = unused(docs, "_node")
    keyed = docs.withColumn(node, F.shiftrightunsigned(F.xxhash64(doc_id, text), 2))
    found = similar_components(keyed.select(node, F.col(text).alias("text")), width, percent, node)
    found = written(found.select(F.col("doc_id").alias("node"), "component_id").distinct())
    several = found.filter("node <> component_id").select("component_id").distinct()
    ids = keyed.select(F.col(node).alias("node"), F.col(doc_id).alias("id")).distinct()
    inside = written(ids.join(found.join(several, "component_id"), "node"))
    least = inside.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "node")).alias("least"))
    away = inside.join(least, "component_id").filter("node <> least.node").select(F.col("node").alias(node))
    away = counted_broadcast(written(away))
    return keyed.join(away, node, "left_anti").select(*[keyed[c] for c in docs.columns])
