"""Contract checks that run as one aggregate each."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table breaks a stated contract."""


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ContractError(f"missing columns: {', '.join(missing)}")
    return df


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Key values that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    if not duplicate_keys(df, *keys).isEmpty():
        raise ContractError(f"duplicate key: {', '.join(keys)}")
    return df


def require_true(df: DataFrame, condition: Column, message: str) -> DataFrame:
    if not df.filter(~F.coalesce(condition, F.lit(False))).isEmpty():
        raise ContractError(message)
    return df


def same_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Set equality: one row with the number of keys found on one side only."""
    lk = left.select(key).distinct().withColumn("l", F.lit(1))
    rk = right.select(key).distinct().withColumn("r", F.lit(1))
    return lk.join(rk, key, "full").agg(
        F.count_if(F.col("r").isNull()).alias("only_left"),
        F.count_if(F.col("l").isNull()).alias("only_right"),
        F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("in_both"),
    )


def one_to_one_outer(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join that refuses duplicate keys on either side."""
    require_unique(left, *keys)
    require_unique(right, *keys)
    return left.join(right, keys, "full")
