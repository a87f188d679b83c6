"""Supports that rest on a displayed piece of evidence: equal keys and equal long text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekgrain.session import reliable_checkpoint


def first_equal_evidence(
    supports: DataFrame, support_id: str, evidence: DataFrame, evidence_id: str, on: Sequence[str], text: str
) -> DataFrame:
    """(support_id, evidence_id) of every support: the smallest id of the evidence with its ``on`` columns and its ``text``, else null.

    Texts meet by two 64-bit fingerprints and are compared afterwards, by the smallest id of a fingerprint only;
    where that differs, the support is joined by its text. Null in a key or in the text matches nothing. Ids are
    expected to be unique and not null.
    """
    prints = [F.xxhash64(text).alias("print_a"), F.xxhash64(F.lit(text), text).alias("print_b")]
    keys = [*on, "print_a", "print_b"]
    asked = supports.filter(F.col(text).isNotNull()).select(F.col(support_id).alias("support"), *on, *prints)
    held = evidence.filter(F.col(text).isNotNull()).select(F.col(evidence_id).alias("evidence"), *on, *prints)
    pairs = asked.join(held.groupBy(*keys).agg(F.min("evidence").alias("evidence")), keys)
    own = supports.select(F.col(support_id).alias("support"), F.col(text).alias("own_text"))
    their = evidence.select(F.col(evidence_id).alias("evidence"), F.col(text).alias("their_text"))
    judged = pairs.join(own, "support").join(their, "evidence").withColumn("same", F.col("own_text") == F.col("their_text"))
    judged = reliable_checkpoint(judged.select("support", "evidence", "same", *keys))

    open_ = judged.filter("NOT same")
    rest = evidence.withColumns({"print_a": prints[0], "print_b": prints[1]}).join(open_.select(*keys).distinct(), keys, "left_semi")
    rest = rest.select(F.col(evidence_id).alias("evidence"), *on, F.col(text).alias("own_text"))
    late = open_.select("support", *on).join(own, "support").join(rest, [*on, "own_text"])
    late = late.groupBy("support").agg(F.min("evidence").alias("evidence"))
    found = judged.filter("same").select("support", "evidence").unionByName(late)
    rows = supports.select(F.col(support_id).alias("support")).join(found, "support", "left")
    return rows.select(F.col("support").alias(support_id), F.col("evidence").alias("evidence_id"))
