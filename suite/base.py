"""Tables, registration and SQL fragments shared by the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekgrain.functions import vocabulary as vocab

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given parquet tables of one scale, by name.

    A small file is one row group and so one task; ``seekgrain.spread`` deals its rows out to that many.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        spread = int(self.spark.conf.get("seekgrain.spread", "0"))
        return table.repartition(spread) if spread and name in ("documents", "pages") else table


def _wide_integers(df: DataFrame) -> DataFrame:
    """Counts and ranks as 64-bit integers, as the SQL side has them."""
    return df.select(
        *[
            F.col(f.name).cast("bigint").alias(f.name) if f.dataType == T.IntegerType() else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def query(name: str, oracle: str | None = None):
    """Register a query; ``oracle`` is the same question in SQL."""

    def add(function: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: _wide_integers(function(Tables(spark, folder)))
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return add


# ---- SQL fragments: the search form of the given tables' alphabet, tokens, stop words ----------
def sql_fold(text: str) -> str:
    return f"lower(strip_accents(replace({text}, 'ß', 'ss')))"


def sql_words(text: str) -> str:
    return f"regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}]+')"


def sql_tokens(text: str) -> str:
    return f"list_filter({sql_words(sql_fold(text))}, lambda t: length(t) >= 2)"


def sql_list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


SQL_STOPWORDS = sql_list(vocab.STOPWORDS)


