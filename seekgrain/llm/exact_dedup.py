"""Exact duplicates by composable polynomial fingerprints.

A text is read as a polynomial over its bytes. The hash of a chunk, multiplied by the base to the
power of the bytes before it, is that chunk's share of the hash of the whole; shares add up. So the
chunks of one huge document are hashed in different tasks and a sum, which Spark combines before
the shuffle, puts them together. Rows with equal fingerprints and lengths are then compared chunk by
chunk: all members of a group agree when the least and the greatest chunk at every place are the
same. A group that fails (a collision of fingerprints) is split by its texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekgrain.llm.common import SPACES, giving_back, unused, written

MODULI = (2_147_483_647, 2_147_483_629)
BASES = (1_103_515_245, 1_540_483_477)
CHUNK_BYTES = 1 << 16
KEY = ["fp_a", "fp_b", "n_bytes"]


def normal_text(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def _powers(base: int, modulus: int, n: int) -> np.ndarray:
    """base ** i mod modulus for i below n, by doubling."""
    out = np.ones(n, dtype=np.int64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * pow(base, done, modulus) % modulus
        done += more
    return out


def chunk_shares(moduli: tuple[int, int], chunk_bytes: int):
    """Shares of chunks in the fingerprint of their text, for ``mapInArrow``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [_powers(b % m, m, chunk_bytes) for b, m in zip(BASES, moduli)]
        for batch in batches:
            numbers = batch.column("chunk_no").to_pylist()
            shares = np.empty((2, len(numbers)), dtype=np.int64)
            for row, (no, chunk) in enumerate(zip(numbers, batch.column("chunk"))):
                body = np.frombuffer(chunk.as_buffer(), dtype=np.uint8).astype(np.int64) + 1
                for k, (base, modulus) in enumerate(zip(BASES, moduli)):
                    own = int(body @ tables[k][: len(body)]) % modulus
                    shares[k, row] = own * pow(base, no * chunk_bytes, modulus) % modulus
            rest = [batch.column(n) for n in ("doc_id", "text_key", "n_bytes", "text_sha256", "chunk_no")]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(shares[0]), pa.array(shares[1])],
                names=["doc_id", "text_key", "n_bytes", "text_sha256", "chunk_no", "a", "b"],
            )

    return giving_back(run)


def _chunks(body: str, chunk_bytes: int) -> Column:
    return F.expr(
        f"transform(sequence(0, greatest(0, cast((n_bytes - 1) div {chunk_bytes} as int))), "
        f"i -> struct(i as chunk_no, substring({body}, i * {chunk_bytes} + 1, {chunk_bytes}) as chunk))"
    )


def _identified(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text_key and the normal text as bytes; a row is known by its id and text."""
    return (
        docs.select(F.col(doc_id).alias("doc_id"), normal_text(F.col(text)).alias("norm"))
        .withColumn("text_key", F.xxhash64("norm"))
        .withColumn("body", F.col("norm").cast("binary"))
        .withColumn("n_bytes", F.octet_length("norm").cast("long"))
    )


def fingerprints(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", moduli=MODULI, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """One row per distinct (doc_id, normal text): text_key, fp_a, fp_b, n_bytes, text_sha256, copies."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    long_text = F.coalesce(F.octet_length("text") > chunk_bytes, F.lit(False))
    slim = ["doc_id", "text_key", "n_bytes", "text_sha256"]
    short = (
        _identified(source.filter(~long_text), "doc_id", "text")
        .withColumn("text_sha256", F.sha2("body", 256))
        .select(*slim, F.lit(0).alias("chunk_no"), F.col("body").alias("chunk"))
    )
    # The chunks of a long text go to different tasks.
    long = (
        _identified(source.filter(long_text), "doc_id", "text")
        .withColumn("text_sha256", F.sha2("body", 256))
        .select(*slim, F.inline(_chunks("body", chunk_bytes)))
        .repartition(F.xxhash64("text_key", "chunk_no"))
    )
    schema = "doc_id long, text_key long, n_bytes long, text_sha256 string, chunk_no int, a long, b long"
    shares = short.unionByName(long).withColumn("doc_id", F.col("doc_id").cast("long"))
    shares = shares.mapInArrow(chunk_shares(moduli, chunk_bytes), schema)
    whole = shares.groupBy("doc_id", "text_key", "n_bytes").agg(
        F.sum("a").alias("a"),
        F.sum("b").alias("b"),
        F.count_if(F.col("chunk_no") == 0).alias("copies"),
        F.max("text_sha256").alias("text_sha256"),
    )
    return whole.select(
        "doc_id", "text_key",
        F.expr(f"(a div copies) % {moduli[0]}").alias("fp_a"),
        F.expr(f"(b div copies) % {moduli[1]}").alias("fp_b"),
        "n_bytes", "text_sha256", "copies",
    )


def equal_texts(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", moduli=MODULI, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """Groups of equal texts: doc_id, text_key, copies, keep_id, group_size, n_bytes, text_sha256.

    Texts are equal after each run of white space becomes one space; null counts as empty. One row
    comes back per distinct (doc_id, text); ``copies`` tells how often that row is repeated, and
    ``group_size`` counts every row. ``keep_id`` is the smallest id of the group; null ids only stay
    where a group has no other. An empty table gives no rows; other columns are not looked at.
    """
    rows = written(fingerprints(docs, doc_id, text, moduli, chunk_bytes))
    groups = rows.groupBy(*KEY).agg(
        F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"), F.count("*").alias("members")
    )
    several = written(groups.filter("members > 1").drop("members"))
    suspects = rows.join(several.select(*KEY), KEY, "left_semi")
    source = _identified(docs, doc_id, text).withColumn("doc_id", F.col("doc_id").cast("long")).alias("d")
    same_row = F.expr("d.doc_id <=> s.doc_id and d.text_key = s.text_key and d.n_bytes = s.n_bytes")
    texts = source.join(suspects.alias("s"), same_row).select("s.*", "d.norm", "d.body")
    pieces = texts.select(*KEY, F.inline(_chunks("body", chunk_bytes)))
    place = F.struct(*KEY, "chunk_no").alias("place")
    differing = (
        pieces.groupBy(place)
        .agg(F.min("chunk").alias("least"), F.max("chunk").alias("greatest"))
        .filter("least <> greatest")
    )
    collided = written(differing.select("place.*").select(*KEY).distinct())
    plain = rows.join(several, KEY, "left").select(
        "doc_id", "text_key", "copies", *KEY, "text_sha256",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", "copies").alias("group_size"),
    )
    columns = ["doc_id", "text_key", "copies", "keep_id", "group_size", "n_bytes", "text_sha256"]
    if collided.isEmpty():
        return plain.select(*columns)
    apart = texts.join(collided, KEY, "left_semi").select(
        "doc_id", "text_key", "copies", *KEY, "text_sha256", F.col("norm").alias("same")
    )
    parts = apart.groupBy(*KEY, "same").agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    apart = apart.distinct().join(parts, [*KEY, "same"])
    return plain.join(collided, KEY, "left_anti").select(*columns).unionByName(apart.select(*columns))


def kept_rows(groups: DataFrame) -> DataFrame:
    """One row per document of ``equal_texts``, repeats included, with its verdict ``kept``."""
    return groups.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).withColumn(
        "kept", F.expr("doc_id <=> keep_id and copy = 1")
    )


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they are."""
    keep = equal_texts(docs, doc_id, text).filter("doc_id <=> keep_id")
    key, number = unused(docs, "_key"), unused(docs, "_copy")
    keep = written(keep.select("doc_id", "text_key", "copies"))
    keyed = docs.withColumn(key, F.xxhash64(normal_text(F.col(text))))
    same = keyed[doc_id].eqNullSafe(keep["doc_id"]) & (keyed[key] == keep["text_key"])
    stay = keyed.join(keep, same, "left_semi")
    if not keep.filter("copies > 1").isEmpty():
        first = Window.partitionBy(doc_id, key).orderBy(F.lit(0))
        stay = stay.withColumn(number, F.row_number().over(first)).filter(F.col(number) == 1).drop(number)
    return stay.drop(key)
