"""Bounded, reproducible training samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seekgrain.llm.common import unused


def bounded_sample(rows: DataFrame, keys: list[str], bound: int, total: int) -> DataFrame:
    """About ``bound`` rows at most, picked by a hash of ``keys``; all rows where ``total`` is within it.

    The share is set 5 % below the bound, so that the final limit, which proves it, cuts nothing off.
    """
    if total <= bound:
        return rows.limit(bound)
    share = int(0.95 * bound / total * 2**31)
    return rows.filter(F.pmod(F.xxhash64(*keys), F.lit(2**31)) < share).limit(bound)


def bounded_classes(rows: DataFrame, label: str, keys: list[str], bound: int, least: int) -> DataFrame:
    """At most max(``least``, ``bound`` / classes) rows of every value of ``label``, picked by a hash of ``keys``.

    Every value is kept at every size of the table: rows are counted per value first, a value's share of
    the hash range is drawn from its own count, and the first rows by hash are taken. Counts per value
    reach the driver.
    """
    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    each = max(least, bound // max(len(counts), 1))
    # Twice the bound is let through, so that a value never goes without rows by chance.
    shares = [(value, min(2**31, int(2 * each / n * 2**31) + 1)) for value, n in counts.items()]
    of, share, place, number = (unused(rows, name) for name in ("_of", "_share", "_place", "_number"))
    table = rows.sparkSession.createDataFrame(shares, f"`{of}` {rows.schema[label].dataType.simpleString()}, `{share}` long")
    some = rows.withColumn(place, F.pmod(F.xxhash64(*keys), F.lit(2**31)))
    some = some.join(F.broadcast(table), rows[label] == F.col(of)).filter(F.col(place) < F.col(share))  # one row per value
    first = Window.partitionBy(label).orderBy(place, F.xxhash64(*[c for c in rows.columns if c != label]))
    return some.withColumn(number, F.row_number().over(first)).filter(F.col(number) <= each).select(*rows.columns)
