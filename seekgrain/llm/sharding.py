"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Documents fall into source parts by a hash. How many rows of each part go to each shard is drawn
from the multivariate hypergeometric law, which is the law of a uniform shuffle: rows are the part
sizes, columns the exact shard sizes. Inside a part a seeded permutation says which rows those are;
rows are exchanged; inside a shard a second permutation gives the slots. Both permutations are ranks
of seeded hashes, counted in slices of bounded size, so no part or shard is ever one task.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seekgrain.llm.common import unused, written

PARTS = 64
#: Rows of one slice of a permutation, on average.
SLICE_ROWS = 20_000


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Good ones among ``draws`` out of ``good + bad``, by inversion from the mode outwards."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low

    def ways(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    peak = math.exp(ways(good, mode) + ways(bad, draws - mode) - ways(good + bad, draws))
    left = rng.random() - peak
    up, down, p_up, p_down = mode, mode, peak, peak
    while left > 0:
        if up >= high and down <= low:
            return mode
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
    return mode


def communication_matrix(parts: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Rows from each part to each shard; rows add up to ``parts``, columns to ``shards``."""
    rng, room, matrix = random.Random(seed), list(shards), []
    for size in parts:
        row, left, total = [], size, sum(room)
        for free in room:
            taken = hypergeometric(rng, free, total - free, left)
            row.append(taken)
            left, total = left - taken, total - free
        room = [free - taken for free, taken in zip(room, row)]
        matrix.append(row)
    return matrix


def shard_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _ranked(df: DataFrame, group: str, identity: list[str], seed: int, slices: int, rank: str) -> DataFrame:
    """Zero-based rank by a seeded hash inside ``group``, counted in ``slices`` slices of the hash range."""
    key, piece, before, own = (unused(df, n) for n in ("_key", "_slice", "_before", "_own"))
    df = df.withColumn(key, F.shiftrightunsigned(F.xxhash64(F.lit(seed), *identity), 1))
    number = F.floor(F.col(key).cast("double") / F.lit(float(2**63)) * slices)
    df = df.withColumn(piece, F.least(number, F.lit(slices - 1)).cast("int"))
    sizes = df.groupBy(group, piece).agg(F.count("*").alias(own))
    upto = Window.partitionBy(group).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(group, piece, F.coalesce(F.sum(own).over(upto), F.lit(0)).alias(before))
    inner = Window.partitionBy(group, piece).orderBy(key, *identity)
    df = df.withColumn(own, F.row_number().over(inner)).join(starts, [group, piece])
    return df.withColumn(rank, F.col(before) + F.col(own) - 1).drop(key, piece, before, own)


def shuffle_into_shards(
    docs: DataFrame, identity: list[str], shards: int = 16, seed: int = 0, parts: int = PARTS
) -> DataFrame:
    """``docs`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each shard).

    Shard sizes differ by one row at most. ``identity`` names orderable columns that tell rows apart;
    rows equal in all of them (repeats) get their places in any order, and nulls count as a value.
    The same rows and seed give the same result. An empty table gives an empty one. Existing columns
    named ``shard`` or ``slot`` are replaced.
    """
    docs = docs.drop("shard", "slot")
    part, rank, cuts = unused(docs, "_part"), unused(docs, "_rank"), unused(docs, "_cuts")
    rows = written(docs.withColumn(part, F.pmod(F.xxhash64(F.lit(seed), *identity), F.lit(parts)).cast("int")))
    sizes = {r[0]: r[1] for r in rows.groupBy(part).count().collect()}  # one row per part, PARTS at most
    total = sum(sizes.values())
    matrix = communication_matrix([sizes.get(p, 0) for p in range(parts)], shard_sizes(total, shards), seed)
    bounds = json.dumps([{"p": p, "c": [sum(row[: s + 1]) for s in range(shards)]} for p, row in enumerate(matrix)])
    spark = docs.sparkSession
    table = spark.range(1).select(
        F.inline(F.from_json(F.lit(bounds), "array<struct<p: int, c: array<bigint>>>")).alias(part, cuts)
    )
    slices = max(1, total // (parts * SLICE_ROWS))
    local = _ranked(rows, part, identity, seed + 1, slices, rank)
    placed = local.join(F.broadcast(table), part).withColumn(
        "shard", F.size(F.filter(cuts, lambda c: c <= F.col(rank))).cast("int")
    )
    placed = placed.drop(part, rank, cuts)
    slices = max(1, total // (shards * SLICE_ROWS))
    placed = _ranked(placed, "shard", identity, seed + 2, slices, "slot")
    return placed.select(*docs.columns, "shard", F.col("slot").cast("long").alias("slot"))
