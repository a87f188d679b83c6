"""SentencePiece encoding and decoding with a max-plus scan over boundary states.

The best segmentation of a text is the best path through the lattice of its pieces. Pieces have at
most K characters, so where a text is cut, a path has K possible states: how many characters the
piece across the cut reaches over. A part of the text is then a K x K matrix of best scores from the
state at its start to the state at its end; matrices combine by max and plus, which is associative.
A giant document is cut into chunks whose matrices are made in different tasks; their product tells
the state at every cut, and each chunk is segmented by itself from its own state to the next.
Scores are whole numbers, kept as costs (their negatives), so the order of combining changes nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekgrain.llm.common import giving_back, unused, written
from seekgrain.llm.shingles import mixed, text_runs

#: Characters of a chunk; longer texts are encoded chunk by chunk.
CHUNK_CHARS = 1 << 16
#: Neighbouring matrices that are combined at once; their products are combined again until one is left.
FAN = 64
#: Characters that are segmented in one go; longer runs without a sure boundary are cut by matrices.
LONG = 256
UNIT = 1 << 16
#: Texts are encoded in runs of about this many bytes, and their distinct stretches in lattices of so many.
RUN_BYTES, LATTICE_STRETCHES = 1 << 21, 1 << 14
SPACE_SIGN = "▁"
NEVER = np.int64(1) << 60
SLOT_BITS = 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Pieces:
    """Hashed prefixes of all pieces with the id (or -1) and cost of those that are pieces themselves."""

    prefixes: np.ndarray
    slots: np.ndarray
    ids: np.ndarray
    costs: np.ndarray
    unknown_cost: int
    longest: int
    byte_ids: np.ndarray
    unknown_id: int
    words_apart: bool
    isolated: np.ndarray
    dummy_prefix: bool
    texts: list[bytes]

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Row of the first prefix hash not below each code, from the slot of its leading bits."""
        at = self.slots[codes >> np.uint64(64 - SLOT_BITS)]
        while (below := self.prefixes[at] < codes).any():
            at = at + below
        return at


def _hash_of(piece: str) -> int:
    h = np.zeros(1, np.uint64)
    with np.errstate(over="ignore"):
        for sign in piece:
            h = mixed(h * _STEP + np.uint64(ord(sign) + 1))
    return int(h[0])


def load_pieces(path: str) -> Pieces:
    """Pieces of a SentencePiece model file.

    A unigram model brings log probabilities. A merge model brings only ranks; by Zipf's law piece r of V
    has the probability 1 / (r ln V), and that is what it is scored with. White space in pieces is a
    space here, so a literal sign for it in a text is spelled in bytes and comes back as it was.
    """
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    unigram = model.trainer_spec.model_type == 1
    whole = math.log(max(len(model.pieces), 3))
    found: dict[str, tuple[int, int]] = {}
    byte_ids, texts = np.full(256, -1, np.int32), []
    for number, piece in enumerate(model.pieces):
        text = piece.piece.replace(SPACE_SIGN, " ")
        if piece.type == 6:
            value = int(piece.piece[1:-1], 16)
            byte_ids[value] = number
            texts.append(bytes([value]))
        elif piece.type in (1, 4):
            bits = -piece.score if unigram else math.log(1 - piece.score) + math.log(whole)
            found[text] = (number, round(UNIT * max(bits, 0.0)))
            texts.append(text.encode())
        else:
            texts.append(b"")
    table = {p[:k] for p in found for k in range(1, len(p) + 1)}
    rows = sorted((_hash_of(p), *found.get(p, (-1, 0))) for p in table)
    known = {sign for p in found for sign in p}
    prefixes = np.array([*(r[0] for r in rows), 2**64 - 1], np.uint64)  # the last one ends every search
    slots = np.searchsorted(prefixes, np.arange(1 << SLOT_BITS, dtype=np.uint64) << np.uint64(64 - SLOT_BITS))
    rows.append((0, -1, 0))
    return Pieces(
        prefixes,
        slots.astype(np.int32),
        np.array([r[1] for r in rows], np.int32),
        np.array([r[2] for r in rows], np.int64),
        max(c for _, c in found.values()) + 10 * UNIT,
        max(map(len, found)),
        byte_ids,
        model.trainer_spec.unk_id,
        not any(" " in p.lstrip(" ") for p in found),
        np.array([chr(b) not in known for b in range(128)] + [False] * 128),
        model.normalizer_spec.add_dummy_prefix,
        texts,
    )


def _signs(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all strings and their offsets."""
    signs = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return signs, np.r_[0, np.cumsum([len(s) for s in strings], dtype=np.int64)]


def best_paths(pieces: Pieces, signs: np.ndarray, offsets: np.ndarray):
    """(cost, length, piece) of the best way to every node; string i has nodes offsets[i] + i to offsets[i + 1] + i.

    At equal cost the longest last piece wins. All strings advance together, one place at a time.
    """
    lengths = np.diff(offsets)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(signs)) - offsets[:-1][owner]
    room = lengths[owner] - place
    at, code = np.arange(len(signs)), np.zeros(len(signs), np.uint64)
    unknown = np.ones(len(signs), bool)
    found = []
    with np.errstate(over="ignore"):
        for length in range(1, pieces.longest + 1):
            code = mixed(code * _STEP + (signs[at + length - 1].astype(np.uint64) + np.uint64(1)))
            spot = pieces.find(code)
            alive = pieces.prefixes[spot] == code
            at, code, spot = at[alive], code[alive], spot[alive]
            whole = pieces.ids[spot] >= 0
            found.append((at[whole], np.full(int(whole.sum()), length), pieces.ids[spot[whole]], pieces.costs[spot[whole]]))
            if length == 1:
                unknown[at[whole]] = False
            more = room[at] > length
            at, code = at[more], code[more]
            if not len(at):
                break
    lone = np.flatnonzero(unknown)
    found.append((lone, np.ones(len(lone), np.int64), np.full(len(lone), -1, np.int32), np.full(len(lone), pieces.unknown_cost)))
    at, length, number, cost = (np.concatenate([f[k] for f in found]) for k in range(4))
    order = np.argsort(place[at], kind="stable")
    at, length, number, cost = at[order], length[order], number[order], cost[order]
    steps = np.searchsorted(place[at], np.arange(int(lengths.max(initial=0)) + 1))
    node = at + owner[at]
    target = node + length
    best = np.full(len(signs) + len(lengths), NEVER)
    best[offsets[:-1] + np.arange(len(lengths))] = 0
    back = np.zeros(len(best), np.int64)
    by = np.full(len(best), -1, np.int32)
    for s, e in zip(steps[:-1], steps[1:]):
        way, goal = best[node[s:e]] + cost[s:e], target[s:e]
        better = way < best[goal]
        goal = goal[better]
        best[goal], back[goal], by[goal] = way[better], length[s:e][better], number[s:e][better]
    return best, back, by


def _part_matrix(pieces: Pieces, signs: np.ndarray, size: int) -> np.ndarray:
    """Costs from state a at the start of ``signs`` to state b after ``size`` characters; signs reach K - 1 further."""
    k = pieces.longest
    entries = [signs[min(a, len(signs)) :] for a in range(k)]
    offsets = np.r_[0, np.cumsum([len(e) for e in entries])]
    best, _, _ = best_paths(pieces, np.concatenate(entries), offsets)
    matrix = np.full((k, k), NEVER)
    for a in range(k):
        for b in range(k):
            if a <= size + b <= len(signs):
                matrix[a, b] = best[offsets[a] + a + size + b - a]
    return matrix


def combine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The max-plus product, on costs."""
    return np.minimum((x[:, :, None] + y[None, :, :]).min(axis=1), NEVER)


def boundary_states(matrices: list[np.ndarray], first: int = 0, last: int = 0) -> list[int]:
    """State at the end of every part on the best way from state ``first`` to state ``last`` over all of them."""
    start = np.full(len(matrices[0]), NEVER) if matrices else np.zeros(0, np.int64)
    start[first : first + 1] = 0
    ways = [start]
    for matrix in matrices:
        ways.append(np.minimum((ways[-1][:, None] + matrix).min(axis=0), NEVER))
    states = [last]
    for way, matrix in zip(ways[-2::-1], matrices[::-1]):
        states.append(int((way + matrix[:, states[-1]]).argmin()))
    return states[::-1][1:]


def cut_long(pieces: Pieces, text: str) -> list[str]:
    """``text`` in parts of about LONG characters whose best segmentations make up the best one of the whole."""
    signs, _ = _signs([text])
    starts = range(0, len(text), LONG)
    matrices = [_part_matrix(pieces, signs[s : s + LONG + pieces.longest - 1], min(LONG, len(text) - s)) for s in starts]
    cuts = [min(s + LONG, len(text)) + state for s, state in zip(starts, boundary_states(matrices))]
    return [text[s:e] for s, e in zip([0, *cuts[:-1]], cuts)]


def _spelled(pieces: Pieces, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte pieces of single characters, and how many each has; the unknown piece where the model has none."""
    if (pieces.byte_ids < 0).any():
        return np.full(len(signs), pieces.unknown_id, np.int32), np.ones(len(signs), np.int64)
    raw = [chr(s).encode("utf-8", "surrogatepass") for s in signs.tolist()]
    return pieces.byte_ids[np.frombuffer(b"".join(raw), np.uint8)], np.array([len(r) for r in raw], np.int64)


def segment(pieces: Pieces, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of the best segmentation of every string."""
    parts, part_of = [], []
    for number, string in enumerate(strings):
        own = cut_long(pieces, string) if len(string) > LONG else [string]
        parts += own
        part_of += [number] * len(own)
    signs, offsets = _signs(parts)
    _, back, by = best_paths(pieces, signs, offsets)
    live, node = np.arange(len(parts)), offsets[1:] + np.arange(len(parts))
    first = offsets[:-1] + np.arange(len(parts))
    taken = []
    while len(live):
        going = node > first[live]
        live, node = live[going], node[going]
        taken.append((live, node - live, by[node]))
        node = node - back[node]
    part, stop, number = (np.concatenate([t[i] for t in taken]) if taken else np.zeros(0, np.int64) for i in range(3))
    order = np.argsort(stop, kind="stable")  # places rise with the parts
    part, stop, number = part[order], stop[order], number[order].astype(np.int32)
    count = np.ones(len(part), np.int64)
    strange = np.flatnonzero(number < 0)
    if len(strange):
        spelled, count[strange] = _spelled(pieces, signs[stop[strange] - 1])
        unknown = np.repeat(number < 0, count)
        number = np.repeat(number, count)
        number[unknown] = spelled
    of = np.array(part_of, np.int64)[np.repeat(part, count)] if len(part) else np.zeros(0, np.int64)
    return number, np.r_[0, np.cumsum(np.bincount(of, minlength=len(strings)))]


def sure_boundaries(pieces: Pieces, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Byte places no piece reaches across: text starts, spaces after something else, around unknown signs."""
    if not len(data):
        return np.zeros(0, np.int64)
    lone = pieces.isolated[data]
    cut = np.r_[True, lone[:-1]] | lone
    if pieces.words_apart:
        space = data == 32
        cut |= space & ~np.r_[False, space[:-1]]
    cut[starts[starts < len(data)]] = True
    return np.flatnonzero(cut)


def gather(values: np.ndarray, counts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of the lists ``rows`` picks out of consecutive lists with ``counts`` values."""
    begins = np.cumsum(counts) - counts
    size = counts[rows]
    total = np.r_[0, np.cumsum(size)]
    return values[np.repeat(begins[rows] - total[:-1], size) + np.arange(total[-1])], total


def decode_flat(pieces: Pieces, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of lists of ids, the space that the model puts first still there."""
    sizes = np.array([len(t) for t in pieces.texts], np.int64)
    data, at = gather(np.frombuffer(b"".join(pieces.texts), np.uint8), sizes, ids)
    return data, at[offsets]


def encode_texts(pieces: Pieces, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of all texts. Stretches between sure boundaries are segmented once each."""
    column = pa.array(texts, pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64)[: len(texts) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[: ends[-1]] if body is not None else np.zeros(0, np.uint8)
    cuts = sure_boundaries(pieces, data, ends[:-1])
    if not len(cuts):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    stretches = pa.LargeStringArray.from_buffers(len(cuts), pa.py_buffer(np.r_[cuts, len(data)].astype(np.int64)), body)
    coded = stretches.dictionary_encode()
    distinct, found, counts = coded.dictionary, [], []
    for start in range(0, len(distinct), LATTICE_STRETCHES):
        ids, offsets = segment(pieces, distinct.slice(start, LATTICE_STRETCHES).to_pylist())
        found.append(ids), counts.append(np.diff(offsets))
    gathered, total = gather(np.concatenate(found), np.concatenate(counts), coded.indices.to_numpy())
    return gathered, total[np.searchsorted(cuts, ends)]


def chunk_matrix(pieces: Pieces, text: str, size: int) -> np.ndarray:
    """Matrix of a chunk: ``size`` characters of ``text``, which goes on for K - 1 more where there are more."""
    k = pieces.longest
    data = text.encode()
    byte_cuts = sure_boundaries(pieces, np.frombuffer(data, np.uint8), np.zeros(0, np.int64))
    letters = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    cuts = (np.cumsum(letters) - 1)[byte_cuts] if len(byte_cuts) else byte_cuts
    cuts = cuts[(cuts >= k) & (cuts <= size)]
    signs, _ = _signs([text])
    if not len(cuts):
        whole = None
        for s in range(0, size, LONG):
            part = _part_matrix(pieces, signs[s : s + LONG + k - 1], min(LONG, size - s))
            whole = part if whole is None else combine(whole, part)
        return whole
    low, high = int(cuts[0]), int(cuts[-1])

    def costs(strings: list[str]) -> np.ndarray:
        # Long stretches are cut where their best path has a boundary, so that costs add up.
        parts = [cut_long(pieces, s) if len(s) > LONG else [s] for s in strings]
        flat, offsets = _signs([p for own in parts for p in own])
        best, _, _ = best_paths(pieces, flat, offsets)
        each = best[offsets[1:] + np.arange(len(offsets) - 1)]
        return np.add.reduceat(each, np.r_[0, np.cumsum([len(p) for p in parts])[:-1]])

    into = costs([text[a:low] for a in range(k)])
    middle = 0
    if high > low:
        column = [text[s:e] for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        names, counts = np.unique(np.array(column, dtype=object).astype(str), return_counts=True)
        middle = int((costs(names.tolist()) * counts).sum())
    reach = [b for b in range(k) if size + b <= len(text)]
    out = np.full(k, NEVER)
    ends = [text[high : size + b] for b in reach]
    out[reach] = [0 if not s else c for s, c in zip(ends, costs([s or " " for s in ends]))]
    return np.minimum(into[:, None] + middle + out[None, :], NEVER)


def _with_prefix(pieces: Pieces, text: str | None) -> str:
    return (" " + text if pieces.dummy_prefix else text) if text else ""


def _comes_back(pieces: Pieces, texts: list[str], ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    data, at = decode_flat(pieces, ids, offsets)
    return np.array([data[s:e].tobytes() == t.encode() for t, s, e in zip(texts, at[:-1], at[1:])], bool)


def _encoded(column: str, result: str, pieces, prefix: bool, check: str | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces.value
        for batch in batches:
            for part in text_runs(batch, column, RUN_BYTES):
                texts = part.column(column).to_pylist()
                whole = [_with_prefix(known, t) if prefix else t or "" for t in texts]
                ids, offsets = encode_texts(known, whole)
                lists = pa.ListArray.from_arrays(
                    pa.array(offsets.astype(np.int32), mask=np.r_[np.array([t is None for t in texts], bool), False]),
                    pa.array(ids, pa.int32()),
                )
                added = {result: lists}
                if check:
                    added[check] = pa.array(_comes_back(known, whole, ids, offsets))
                yield pa.RecordBatch.from_arrays([*part.columns, *added.values()], names=[*part.schema.names, *added])

    return giving_back(run)


def _matrices(pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("chunk").to_pylist(), batch.column("size").to_pylist())
            found = [chunk_matrix(pieces.value, text, size).tobytes() for text, size in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("no"), pa.array(found, pa.binary())], names=["row", "no", "matrix"]
            )

    return giving_back(run)


def _chunks(chars: int, longest: int, lead: str):
    """(row, no, size, chunk) of every text; a chunk has the signs after it that a piece across its end can reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row, text = batch.column("row")[i].as_py(), lead + batch.column("text")[i].as_py()
                for no, start in enumerate(range(0, len(text), chars)):
                    size, part = min(chars, len(text) - start), text[start : start + chars + longest - 1]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row], pa.int64()), pa.array([no], pa.int64()), pa.array([size], pa.int64()), pa.array([part])],
                        names=["row", "no", "size", "chunk"],
                    )

    return run


def _states(matrices: DataFrame, side: int) -> DataFrame:
    """(row, no, begin, over): the states of the best way at the start and the end of every chunk.

    Products of FAN neighbours make the next level, until one group is left per text; the states then come
    down again, each group finding those inside from its own two. So no group holds more than FAN matrices.
    """

    def read(table: pa.Table) -> tuple[pa.Table, list[np.ndarray]]:
        table = table.sort_by("no")
        return table, [np.frombuffer(m, np.int64).reshape(side, side) for m in table.column("matrix").to_pylist()]

    def product(table: pa.Table) -> pa.Table:
        table, found = read(table)
        whole = found[0]
        for matrix in found[1:]:
            whole = combine(whole, matrix)
        return pa.table({"row": table.column("row")[:1], "no": pa.array([table.column("up")[0].as_py()]), "matrix": pa.array([whole.tobytes()])})

    def inside(table: pa.Table) -> pa.Table:
        table, found = read(table)
        ends = boundary_states(found, table.column("first")[0].as_py(), table.column("last")[0].as_py())
        begins = [table.column("first")[0].as_py(), *ends[:-1]]
        return pa.table({"row": table.column("row"), "no": table.column("no"), "begin": pa.array(begins, pa.int64()), "over": pa.array(ends, pa.int64())})

    def grouped(level: DataFrame) -> DataFrame:
        return level.withColumn("up", F.expr(f"no div {FAN}"))

    levels = [matrices]
    while levels[-1].agg(F.max("no")).first()[0] >= FAN:
        levels.append(written(grouped(levels[-1]).groupBy("row", "up").applyInArrow(product, "row long, no long, matrix binary")))
    zero = F.lit(0).cast("long")
    states = levels[-1].select("row", zero.alias("up"), zero.alias("first"), zero.alias("last")).distinct()
    for level in levels[::-1]:
        held = grouped(level).join(states, ["row", "up"])
        found = written(held.groupBy("row", "up").applyInArrow(inside, "row long, no long, begin long, over long"))
        states = found.select("row", F.col("no").alias("up"), F.col("begin").alias("first"), F.col("over").alias("last"))
    return found


def encode(
    docs: DataFrame, pieces: Pieces, text: str = "text", result: str = "ids", chunk_chars: int = CHUNK_CHARS,
    check: str | None = None,
) -> DataFrame:
    """``docs`` with array<int> ``result``: the piece ids of the best segmentation of every whole text.

    Null gives null, an empty text an empty array; a text is otherwise preceded by a space where the model
    says so. Rows are encoded one by one, so repeats get the same ids; an empty table stays empty; a column
    named like the result is replaced. Texts of more than ``chunk_chars`` characters go through the scan.
    ``check`` names a boolean column: the ids decode to exactly the text.
    """
    spark = docs.sparkSession
    docs = docs.drop(result, *([check] if check else []))
    shared = spark.sparkContext.broadcast(pieces)
    fields = [*docs.schema.fields, T.StructField(result, T.ArrayType(T.IntegerType()))]
    schema = T.StructType([*fields, *([T.StructField(check, T.BooleanType())] if check else [])])
    giant = F.coalesce(F.length(text) > chunk_chars, F.lit(False))
    short = docs.filter(~giant).mapInArrow(_encoded(text, result, shared, True, check), schema)
    row = unused(docs, "_row")
    rows = written(docs.filter(giant).withColumn(row, F.monotonically_increasing_id()))
    if rows.isEmpty():
        return short
    whole = rows.select(F.col(row).alias("row"), F.col(text).alias("text"))
    cut = giving_back(_chunks(chunk_chars, pieces.longest, " " if pieces.dummy_prefix else ""))
    chunks = written(whole.mapInArrow(cut, "row long, no long, size long, chunk string").repartition("row", "no"))
    matrices = chunks.select("row", "no", "chunk", "size").mapInArrow(_matrices(shared), "row long, no long, matrix binary")
    states = _states(written(matrices), pieces.longest)
    own = F.substr("chunk", (F.col("begin") + 1).cast("int"), (F.col("size") - F.col("begin") + F.col("over")).cast("int"))
    own = chunks.join(states, ["row", "no"]).select("row", "no", own.alias("chunk"))
    coded = own.mapInArrow(_encoded("chunk", "part", shared, False), "row long, no long, chunk string, part array<int>")
    joined = coded.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("no", "part"))).alias("parts"))
    joined = joined.select(F.col("row").alias(row), F.flatten("parts.part").alias(result))
    long = rows.join(joined, row)
    if check:
        again = unused(long, "_again")
        long = decode(long, pieces, result, again).withColumn(check, F.col(again).eqNullSafe(F.col(text)))
    return short.unionByName(long.select(*schema.names))


def decode(docs: DataFrame, pieces: Pieces, ids: str = "ids", result: str = "text") -> DataFrame:
    """``docs`` with the text of its piece ids; null gives null, ids outside the model raise an error."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    docs = docs.drop(result)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        strip = 1 if known.dummy_prefix else 0
        for batch in batches:
            lists = batch.column(ids)
            flat, sizes = lists.flatten().to_numpy(), pc.list_value_length(lists).fill_null(0).to_numpy()
            if len(flat) and not 0 <= flat.min() <= flat.max() < len(known.texts):
                raise ValueError("an id is not in the model")
            data, at = decode_flat(known, flat, np.r_[0, np.cumsum(sizes)])
            texts = [data[s:e].tobytes()[strip:].decode("utf-8", "replace") for s, e in zip(at[:-1], at[1:])]
            texts = pa.array(texts, pa.string(), mask=np.asarray(lists.is_null()))
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, result])

    schema = T.StructType([*docs.schema.fields, T.StructField(result, T.StringType())])
    return docs.mapInArrow(giving_back(run), schema)


def default_model(spark: SparkSession) -> str:
    """The model file that the session names, or the public one of the image."""
    return spark.conf.get("seekgrain.pieces", "/opt/tokenizers/piece_bpe_32k.model")
