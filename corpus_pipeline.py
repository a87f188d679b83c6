"""A training corpus from ``documents``: good texts, no copies, mixed to target weights, as piece ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seekgrain.llm import exact_dedup, jaccard_join, mixing, piece_scan, quality
from seekgrain.llm.common import written


def good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    trees = quality.fit(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))
    return quality.keep_good(docs, trees)


def one_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of equal texts."""
    return exact_dedup.drop_copies(docs)


def one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near duplicates (five-word shingles, 0.8)."""
    return jaccard_join.keep_first(docs, width=5, percent=80)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document none, one or two times, so that sources come near their target weights."""
    return mixing.mixed_rows(docs)


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the piece ids of their texts."""
    return piece_scan.encode(docs, piece_scan.load_pieces(piece_scan.default_model(spark))).drop("text")


STAGES = [
    ("quality", good_texts),
    ("exact_dedup", one_of_equal),
    ("near_dedup", one_of_similar),
    ("mixing", mixed_sources),
    ("encoding", as_pieces),
]

#: No stage but exact dedup and mixing can be said in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
