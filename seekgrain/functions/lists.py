"""Order-dependent clean-up of short lists held in one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seekgrain.functions import text as tx

# Words that do not tell two items apart, and the similarity limits.
LIGHT_STOPWORDS = (
    "avec dans des les pour une aux ainsi que par sur son ses leur leurs cette tout tous"
).split()
JACCARD = 0.5
CONTAINMENT = 0.75


def stems(value: Column) -> Column:
    """Distinct folded words of three or more characters, plural s dropped from longer ones."""
    found = F.regexp_extract_all(tx.fold(value), F.lit("[a-z0-9]{3,}"), F.lit(0))
    kept = F.filter(found, lambda w: ~w.isin(*LIGHT_STOPWORDS))
    return F.array_distinct(
        F.transform(
            kept, lambda w: F.when((F.length(w) > 4) & F.endswith(w, F.lit("s")), F.left(w, F.length(w) - 1)).otherwise(w)
        )
    )


def nearly_same(left: Column, right: Column) -> Column:
    shared = F.size(F.array_intersect(left, right))
    return (
        (F.size(left) > 0)
        & (F.size(right) > 0)
        & (
            (shared / F.greatest(F.size(F.array_union(left, right)), F.lit(1)) >= JACCARD)
            | (shared / F.greatest(F.least(F.size(left), F.size(right)), F.lit(1)) >= CONTAINMENT)
        )
    )


def unique_items(values: Column) -> Column:
    """Keep an item unless an earlier kept one equals or nearly equals it."""
    shaped = F.transform(
        values,
        lambda v: F.struct(
            tx.strip(v).alias("value"), F.lower(tx.squeeze(v)).alias("key"), stems(v).alias("stems")
        ),
    )
    empty = F.array().cast("array<struct<value:string,key:string,stems:array<string>>>")

    def step(kept: Column, item: Column) -> Column:
        seen = F.exists(kept, lambda k: (k["key"] == item["key"]) | nearly_same(item["stems"], k["stems"]))
        return F.when((item["value"] == "") | seen, kept).otherwise(F.array_append(kept, item))

    return F.aggregate(shaped, empty, step, lambda kept: F.transform(kept, lambda k: k["value"]))
