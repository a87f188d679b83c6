"""Cross-tokenizer alignment by pointer jumping.

Two tokenizers cut the bytes of a text; where tokens of both end, a group of overlapping tokens ends. Every
token points to the token that overlaps it and reaches farthest right, and doubling these pointers, for all
tokens of a block of texts at once, takes each to the last token of its group, which labels the group.

Neither tokenizer joins anything across a single space between two other signs, so a text falls into
stretches there and equal stretches are tokenized and aligned once. Texts are kept in blocks of bounded
size: a block holds its distinct stretches with their links, and its documents as lists of stretches.
Corpus-wide counts of linked id pairs come from the blocks' own sums, and each block then meets just the
pairs it holds, so no table of all pairs is sent anywhere whole.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekgrain.llm.common import giving_back, written
from seekgrain.llm.piece_scan import gather

SPACE_SIGN = "▁"
#: A single space between two signs that neither are white space nor stand for it.
STRETCH_END = re.compile(rf"(?<=[^\s{SPACE_SIGN}]) (?=[^\s{SPACE_SIGN}])")
#: Characters of the texts of a block; a longer text is several blocks.
BLOCK_CHARS = 1 << 20
#: Characters whose distinct stretches are tokenized together, and how many of these at once.
RUN_CHARS, ENCODED_AT_ONCE = 1 << 22, 1 << 14
DIGEST = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string"
BLOCK = (
    "block long, keys array<long>, sizes array<int>, stretches array<int>, pairs array<int>, pair_sizes array<int>, "
    "distinct array<long>, times array<long>"
)


def byte_signs() -> dict[str, int]:
    """The sign by which a byte-level vocabulary writes each byte: its own where that is printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass
class Models:
    """The two tokenizer files; what is made of them stays in each worker."""

    a_json: str
    b_model: bytes
    made: dict = field(default_factory=dict)

    def __getstate__(self):
        return {"a_json": self.a_json, "b_model": self.b_model, "made": {}}

    def tokenizers(self):
        if not self.made:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            import sentencepiece
            import tokenizers

            first = tokenizers.Tokenizer.from_str(self.a_json)
            first.encode_special_tokens = True
            second = sentencepiece.SentencePieceProcessor(model_proto=self.b_model)
            self.made.update(a=first, b=second, a_table=Table(self._bytes_of_a()), b_table=Table(_bytes_of_b(second)))
        return self.made

    def _bytes_of_a(self) -> list[bytes]:
        spec, signs = json.loads(self.a_json), byte_signs()
        entries = spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        table = [b""] * (max([*entries.values(), *added.values()]) + 1)
        for entry, number in entries.items():
            table[number] = entry.encode() if entry in added else bytes(signs[s] for s in entry)
        return table


def _bytes_of_b(model) -> list[bytes]:
    def one(number: int) -> bytes:
        piece = model.id_to_piece(number)
        if model.is_byte(number):
            return bytes([int(piece[1:-1], 16)])
        return b"" if model.is_unknown(number) or model.is_control(number) else piece.replace(SPACE_SIGN, " ").encode()

    table = [one(i) for i in range(len(model))]
    if any(SPACE_SIGN in model.id_to_piece(i).lstrip(SPACE_SIGN) for i in range(len(model))):
        raise ValueError("a piece that goes on after a space joins stretches")
    return table


def load_models(a_path: str, b_path: str) -> Models:
    """A byte-level merge tokenizer (JSON) and a SentencePiece merge model that puts a space first."""
    with open(a_path, encoding="utf-8") as a_file, open(b_path, "rb") as b_file:
        return Models(a_file.read(), b_file.read())


def default_models(spark: SparkSession) -> Models:
    """The files that the session names, or the public ones of the image."""
    return load_models(
        spark.conf.get("seekgrain.byte_pairs", "/opt/tokenizers/byte_bpe_50k.json"),
        spark.conf.get("seekgrain.pieces", "/opt/tokenizers/piece_bpe_32k.model"),
    )


def links(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of all overlapping pairs of tokens of two gapless cuts of one stretch of bytes, in place order.

    Two tokens overlap in one run of bytes, so the pieces between neighbouring ends are the pairs.
    """
    ends = np.union1d(end_a, end_b)
    return np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)


def group_ends(end_a: np.ndarray, end_b: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Last B token of the group of every token, A tokens first, by doubling pointers to the farthest-right neighbour."""
    n = len(end_a)
    of_a = n + b[np.searchsorted(a, np.arange(n), side="right") - 1]
    of_b = a[np.searchsorted(b, np.arange(len(end_b)), side="right") - 1]
    # Of two tokens that end together the B token is the last one.
    of_b = np.where(end_a[of_b] > end_b, of_b, n + np.arange(len(end_b)))
    to = np.r_[of_a, of_b]
    while True:
        further = to[to]
        if (further == to).all():
            return to - n
        to = further


@dataclass
class Aligned:
    """Aligned stretches: (n_a, n_b, n_groups, n_links), the groups spelled out with a ``;`` after each, and the linked pairs.

    ``good`` tells whether the tokens of both sides give the bytes of a stretch back; the others have nothing.
    """

    good: np.ndarray
    counts: np.ndarray
    spelled: np.ndarray
    spelled_sizes: np.ndarray
    pairs: np.ndarray
    pair_sizes: np.ndarray


def aligned(made: dict, stretches: list[str]) -> Aligned:
    parts = [_aligned(made, stretches[s : s + ENCODED_AT_ONCE]) for s in range(0, len(stretches), ENCODED_AT_ONCE)]
    return Aligned(*[np.concatenate([getattr(p, f) for p in parts]) for f in Aligned.__dataclass_fields__])


@dataclass
class Table:
    """Bytes of the tokens of one side, and their ids as decimal numbers with a comma."""

    tokens: list[bytes]

    def __post_init__(self):
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.data = np.frombuffer(b"".join(self.tokens), np.uint8)
        names = [b"%d," % i for i in range(len(self.tokens))]
        self.name_sizes, self.names = np.array([len(n) for n in names], np.int64), np.frombuffer(b"".join(names), np.uint8)

    def gives(self, ids: np.ndarray, counts: np.ndarray, whole: list[bytes]) -> np.ndarray:
        """Which strings the tokens, ``counts`` for each, give back."""
        data, at = gather(self.data, self.sizes, ids)
        ends = at[np.cumsum(counts)]
        data = data.tobytes()
        if data == b"".join(whole) and (ends == np.cumsum([len(w) for w in whole])).all():
            return np.ones(len(whole), bool)
        return np.array([data[s:e] == w for s, e, w in zip([0, *ends.tolist()], ends.tolist(), whole)], bool)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(itertools.chain.from_iterable(lists), np.int64, int(sizes.sum())), sizes


def _aligned(made: dict, stretches: list[str]) -> Aligned:
    a_table, b_table = made["a_table"], made["b_table"]
    spaced = [" " + s for s in stretches]
    whole = [s.encode() for s in spaced]
    ids_a, counts_a = _flat([e.ids for e in made["a"].encode_batch_fast(spaced, add_special_tokens=False)])
    ids_b, counts_b = _flat(made["b"].encode(stretches, num_threads=1))
    good = a_table.gives(ids_a, counts_a, whole) & b_table.gives(ids_b, counts_b, whole)
    ids_a, ids_b = ids_a[np.repeat(good, counts_a)], ids_b[np.repeat(good, counts_b)]
    counts_a, counts_b = counts_a * good, counts_b * good
    end_a, end_b = np.cumsum(a_table.sizes[ids_a]), np.cumsum(b_table.sizes[ids_b])
    a, b = links(end_a, end_b)
    last = group_ends(end_a, end_b, a, b)
    n = len(ids_a)
    ends, group = np.unique(last, return_inverse=True)
    in_a, in_b = np.bincount(group[:n], minlength=len(ends)), np.bincount(group[n:], minlength=len(ends))
    upto_a, upto_b = np.cumsum(in_a), np.cumsum(in_b)
    # The A tokens of a group come first, then its B tokens.
    spot_a = np.arange(n) + (upto_b - in_b)[group[:n]]
    spot_b = np.arange(len(ids_b)) + upto_a[group[n:]]
    order = np.empty(n + len(ids_b), np.int64)
    order[spot_a], order[spot_b] = ids_a, ids_b + len(a_table.tokens)
    marks = np.full(len(order), ord(","), np.uint8)
    marks[spot_a[upto_a - 1]], marks[spot_b[upto_b - 1]] = ord("|"), ord(";")
    names, sizes = np.r_[a_table.names, b_table.names], np.r_[a_table.name_sizes, b_table.name_sizes]
    spelled, at = gather(names, sizes, order)
    spelled[at[1:] - 1] = marks
    stop_a, stop_b = np.cumsum(counts_a), np.cumsum(counts_b)
    stops = [np.searchsorted(ends, stop_b), np.searchsorted(b, stop_b), at[stop_a + stop_b]]
    n_groups, n_links, n_spelled = (np.diff(x, prepend=0) for x in stops)
    counts = np.stack([counts_a, counts_b, n_groups, n_links], axis=1)
    return Aligned(good, counts, spelled, n_spelled, ids_a[a] << 32 | ids_b[b], n_links)


class _Run:
    """Pieces of texts as lists of stretches, their distinct stretches aligned once."""

    def __init__(self, made: dict, pieces: list[str]):
        number: dict[str, int] = {}
        lists = [np.fromiter((number.setdefault(s, len(number)) for s in STRETCH_END.split(p)), np.int64) for p in pieces]
        self.known = known = aligned(made, list(number))
        self.flat = np.concatenate(lists)
        self.at = np.r_[0, np.cumsum([len(x) for x in lists])]
        first = self.at[:-1]
        self.good = np.logical_and.reduceat(known.good[self.flat], first)
        self.counts = np.add.reduceat(known.counts[self.flat], first, axis=0)

    def groups(self, k: int) -> bytes:
        """The groups of a piece, spelled out, with a ``;`` after each."""
        return gather(self.known.spelled, self.known.spelled_sizes, self.flat[self.at[k] : self.at[k + 1]])[0].tobytes()

    def row(self, block: int, pieces: list[int], keys: list[int]) -> dict:
        """Some pieces as one row of the block table."""
        sizes = np.diff(self.at)[pieces]
        own, stretches, times = np.unique(
            np.concatenate([self.flat[self.at[k] : self.at[k + 1]] for k in pieces]), return_inverse=True, return_counts=True
        )
        pair_sizes = self.known.pair_sizes[own]
        pairs, _ = gather(self.known.pairs, self.known.pair_sizes, own)
        distinct, of = np.unique(pairs, return_inverse=True)
        weight = np.bincount(of, weights=np.repeat(times, pair_sizes), minlength=len(distinct)).astype(np.int64)
        return {
            "block": block, "keys": keys, "sizes": sizes.astype(np.int32), "stretches": stretches.astype(np.int32),
            "pairs": of.astype(np.int32), "pair_sizes": pair_sizes.astype(np.int32), "distinct": distinct, "times": weight,
        }


def _cut(text: str, chars: int) -> Iterator[str]:
    """A long text in pieces of about so many characters that end between stretches."""
    at = 0
    while len(text) - at > chars:
        end = STRETCH_END.search(text, at + chars)
        if not end:
            break
        yield text[at : end.start()]
        at = end.end()
    yield text[at:]


def _tokenized(models, spelled: bool, schema: T.StructType):
    kinds = pa.schema([(f.name, _arrow(f.dataType)) for f in schema.fields[1:]])
    digest_names = [f.split()[0] for f in DIGEST.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = models.value.tokenizers()
        task = TaskContext.get().partitionId() << 33
        serial = blocks = task
        payload = None

        def row_batch(row: dict) -> pa.RecordBatch:
            columns = [pa.nulls(1, payload)] + [
                pa.array([row.get(f.name)], f.type) if f.name in row else pa.nulls(1, f.type) for f in kinds
            ]
            return pa.RecordBatch.from_arrays(columns, names=["payload", *kinds.names])

        def blocks_of(run: _Run, wanted: list[int], keys: list[int], chars: list[int]) -> Iterator[dict]:
            """Rows of the ``wanted`` pieces of a run, each of about BLOCK_CHARS."""
            nonlocal blocks
            total = np.cumsum([chars[k] for k in wanted]) // BLOCK_CHARS
            for _, some in itertools.groupby(zip(total.tolist(), wanted), key=lambda x: x[0]):
                some = [k for _, k in some]
                yield run.row(blocks, some, [keys[k] for k in some])
                blocks += 1

        def digest(runs: Iterator[tuple[_Run, list[int]]]) -> tuple | None:
            """The results of a text from its pieces; None where one of them does not give its bytes back."""
            total, state, spells, last = np.zeros(4, np.int64), hashlib.sha256(), [], b""
            for run, pieces in runs:
                if not run.good[pieces].all():
                    return None
                for k in pieces:
                    state.update(last[-1:])
                    last = run.groups(k)
                    state.update(last[:-1])
                    spells.append(last.decode() if spelled else "")
                total = total + run.counts[pieces].sum(axis=0)
            return (*total.tolist(), state.hexdigest(), "".join(spells)[:-1])

        def giant(text: str, key: int) -> tuple[tuple | None, list[dict]]:
            """A text of several runs; its blocks count only when all of its pieces are good."""
            rows: list[dict] = []

            def runs():
                for piece in _cut(text, RUN_CHARS):
                    parts = list(_cut(piece, BLOCK_CHARS))
                    run = _Run(made, parts)
                    yield run, list(range(len(parts)))
                    rows.extend(blocks_of(run, list(range(len(parts))), [key] * len(parts), [len(p) for p in parts]))

            found = digest(runs())
            return found, rows if found else []

        def several(texts: list[str], keys: list[int]) -> tuple[list[tuple | None], list[dict]]:
            """Texts of one run."""
            parts, of = [], []
            for k, text in enumerate(texts):
                own = list(_cut(text, BLOCK_CHARS))
                parts += own
                of += [k] * len(own)
            run = _Run(made, parts)
            found = [digest(iter([(run, list(p))])) for _, p in itertools.groupby(range(len(parts)), key=of.__getitem__)]
            wanted = [p for p in range(len(parts)) if found[of[p]]]
            return found, list(blocks_of(run, wanted, [keys[k] for k in of], [len(p) for p in parts]))

        for batch in batches:
            payload = batch.column("payload").type
            texts = batch.column("text").to_pylist()
            found: list[tuple] = [(0, 0, 0, 0, "", "")] * len(texts)
            waiting, size = [], 0
            for i in range(len(texts) + 1):
                text = texts[i] if i < len(texts) else None
                if text and len(text) > RUN_CHARS:
                    one, rows = giant(text, serial + i)
                    found[i] = one or found[i]
                    yield from map(row_batch, rows)
                elif text:
                    waiting.append(i)
                    size += len(text)
                if waiting and (size >= RUN_CHARS or i == len(texts)):
                    some, rows = several([texts[k] for k in waiting], [serial + k for k in waiting])
                    for k, one in zip(waiting, some):
                        found[k] = one or found[k]
                    yield from map(row_batch, rows)
                    waiting, size = [], 0
            columns = dict(zip(digest_names, zip(*found))) if found else {}
            keys = {"key": range(serial, serial + len(texts))}
            serial += len(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("payload"), *[pa.array(c, f.type) if (c := (columns | keys).get(f.name)) else pa.nulls(len(texts), f.type) for f in kinds]],
                names=["payload", *kinds.names],
            )

    return giving_back(run)


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    return {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.StringType: pa.string()}[type(kind)]


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n_best, count_sum) of every document of a block, from the block's stretches and its pairs' counts."""
    for batch in batches:
        for i in range(batch.num_rows):
            keys, sizes, stretches, pairs, pair_sizes, met = (
                batch.column(c)[i].values for c in ("keys", "sizes", "stretches", "pairs", "pair_sizes", "met")
            )
            pair, count, best = (met.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            at = np.argsort(pair)[pairs.to_numpy()]  # pairs are numbered in this order
            ends = np.r_[0, np.cumsum(pair_sizes.to_numpy())]
            stops = np.r_[0, np.cumsum(sizes.to_numpy())]
            columns = []
            for value in (best.astype(np.int64), count):
                running = np.r_[0, np.cumsum(value[at])]
                each = (running[ends[1:]] - running[ends[:-1]])[stretches.to_numpy()]
                running = np.r_[0, np.cumsum(each)]
                columns.append(pa.array(running[stops[1:]] - running[stops[:-1]]))
            yield pa.RecordBatch.from_arrays([keys, *columns], names=["key", "n_best", "count_sum"])


@dataclass
class Alignment:
    """What ``align`` finds: one row per document, and (a_id, b_id, count, best) of all linked id pairs."""

    documents: DataFrame
    pairs: DataFrame


def align(docs: DataFrame, models: Models, text: str = "text", keep_groups: bool = False) -> Alignment:
    """Groups and links of the tokens of both tokenizers in every whole text of ``docs``.

    Documents have the columns of ``docs`` but the text, in a struct ``payload``, and n_a, n_b, n_groups,
    n_links, n_best (links whose pair count is the highest of their B id), count_sum (of the pair counts over
    the links), groups_sha256 and, where ``keep_groups`` asks for it, ``groups`` as ``a1,a2|b1;a3|b2,b3``.
    Texts that are null or empty, or that one of the tokenizers does not give back byte by byte, have no
    tokens: zeros and empty strings, and no part in the counts. Repeated rows count as often as they come; an
    empty table gives no rows. A stretch without a single space in it is tokenized whole.
    """
    spark = docs.sparkSession
    others = F.struct(*[docs[c] for c in docs.columns if c.lower() != text.lower()])
    rows = docs.select(others.alias("payload"), docs[text].alias("text"))
    own = T.StructType.fromDDL(f"key long, {DIGEST}, {BLOCK}")
    schema = T.StructType([T.StructField("payload", rows.schema["payload"].dataType), *own.fields])
    shared = spark.sparkContext.broadcast(models)  # two vocabulary files
    made = written(rows.mapInArrow(_tokenized(shared, keep_groups, schema), schema))
    blocks = made.filter("block IS NOT NULL")
    held = blocks.select("block", F.inline(F.arrays_zip(F.col("distinct").alias("pair"), F.col("times").alias("times"))))
    counts = written(held.groupBy("pair").agg(F.sum("times").alias("count")))
    counts = counts.withColumn("b", F.col("pair").bitwiseAND((1 << 32) - 1))
    top = counts.groupBy("b").agg(F.max("count").alias("top"))
    # As many rows as the second vocabulary has at most.
    counts = counts.join(F.broadcast(top), "b").withColumn("best", F.col("count") == F.col("top"))
    met = held.select("block", "pair").join(counts.select("pair", "count", "best"), "pair")
    met = met.groupBy("block").agg(F.collect_list(F.struct("pair", "count", "best")).alias("met"))  # a block's own pairs
    full = blocks.select("block", "keys", "sizes", "stretches", "pairs", "pair_sizes").join(met, "block").drop("block")
    sums = full.mapInArrow(giving_back(_scored), "key long, n_best long, count_sum long")
    sums = sums.groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    digest = made.filter("key IS NOT NULL").select("payload", "key", *[f.split()[0] for f in DIGEST.split(", ")])
    found = digest.join(sums, "key", "left").drop("key", *([] if keep_groups else ["groups"]))
    zero = F.lit(0).cast("long")
    found = found.withColumns({c: F.coalesce(c, zero) for c in ("n_best", "count_sum")})
    pairs = counts.select(F.shiftrightunsigned("pair", 32).cast("int").alias("a_id"), F.col("b").cast("int").alias("b_id"), "count", "best")
    return Alignment(found, pairs)
