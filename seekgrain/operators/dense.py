"""Exact vector scoring: many queries as a blocked matrix product."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekgrain.operators.ranking import top_k

QUERY_BLOCK = 500
#: Passages of a part where there are more queries than one block.
PART_ROWS = 20_000


def inner_product(left: Column, right: Column) -> Column:
    return F.aggregate(
        F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def is_finite_vector(vector: Column) -> Column:
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def score_many(
    passages: DataFrame,
    queries: DataFrame,
    depth: int,
    key: str,
    vector: str,
    query: str,
    query_vector: str,
) -> DataFrame:
    """Top ``depth`` passages per query by inner product, exact.

    Up to ``QUERY_BLOCK`` query vectors are held by every task while passages stream through; a task keeps
    its best ``depth`` per query, and the shuffle then sees ``depth`` rows per query and task only. More
    queries stay in Spark: blocks of them meet parts of the passages in one grid of tasks.
    """
    kinds = [(query, queries.schema[query]), (key, passages.schema[key])]
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in kinds] + [T.StructField("score", T.DoubleType())])
    rows = passages.select(key, vector).filter(F.col(vector).isNotNull())
    asked = queries.select(query, query_vector).filter(F.col(query_vector).isNotNull())
    few = asked.limit(QUERY_BLOCK + 1).toPandas()
    if len(few) <= QUERY_BLOCK:

        def stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            yield from _best(frames, few, depth, key, vector, query, query_vector)

        scored = rows.mapInPandas(stream, schema)
    else:
        scored = _grid(rows, asked, schema, depth, key, vector, query, query_vector)
    return top_k(scored, [query], [F.desc("score"), F.col(key)], depth, salt_on=key)


def _grid(rows, asked, schema, depth, key, vector, query, query_vector) -> DataFrame:
    """Best passages of every block of queries in every part of the passages."""
    cell = ["_part", "_block"]
    parts, blocks = (max(1, -(-df.count() // size)) for df, size in ((rows, PART_ROWS), (asked, QUERY_BLOCK)))

    def dealt(df: DataFrame, name: str, own: str, n: int, other: str, m: int) -> DataFrame:
        numbered = df.withColumn(own, F.pmod(F.xxhash64(name), F.lit(n)))
        return numbered.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))))

    def meet(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        found = list(_best([mine], theirs, depth, key, vector, query, query_vector))
        return pd.concat(found) if found else pd.DataFrame({n: [] for n in schema.names})

    left = dealt(rows, key, "_part", parts, "_block", blocks).groupBy(*cell)
    return left.cogroup(dealt(asked, query, "_block", blocks, "_part", parts).groupBy(*cell)).applyInPandas(meet, schema)


def _best(frames, block, depth, key, vector, query, query_vector) -> Iterator[pd.DataFrame]:
    """The best ``depth`` passages of all frames for every query of the block, and those that tie with the last one."""
    ids = list(block[query])
    if not ids:
        return
    matrix = np.vstack([np.asarray(v, dtype=np.float64) for v in block[query_vector]])
    kept_keys = [np.array([], dtype=object)] * len(ids)
    kept_scores = [np.array([])] * len(ids)
    for frame in frames:
        if frame.empty:
            continue
        scores = np.round(np.vstack(frame[vector].to_numpy()).astype(np.float64) @ matrix.T, 6)
        keys = frame[key].to_numpy()
        for i in range(len(ids)):
            all_keys = np.concatenate([kept_keys[i], keys])
            all_scores = np.concatenate([kept_scores[i], scores[:, i]])
            if len(all_scores) > depth:
                # keep every row that ties with the last one; the final rank settles ties by key
                limit = -np.partition(-all_scores, depth - 1)[depth - 1]
                chosen = all_scores >= limit
                if chosen.sum() > 2 * depth:
                    order = np.lexsort((all_keys, -all_scores))[:depth]
                    all_keys, all_scores = all_keys[order], all_scores[order]
                else:
                    all_keys, all_scores = all_keys[chosen], all_scores[chosen]
            kept_keys[i], kept_scores[i] = all_keys, all_scores
    for i, name in enumerate(ids):
        if len(kept_scores[i]):
            yield pd.DataFrame({query: name, key: kept_keys[i], "score": kept_scores[i]})
