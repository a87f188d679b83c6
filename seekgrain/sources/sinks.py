"""Writers: versioned parquet, CSV, stored index, manifests and event lines."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekgrain.operators.lexical import LexicalIndex
from seekgrain.sources.tables import file_hashes


def write_table(df: DataFrame, path: str) -> None:
    """A corpus version is written once; an existing one is never replaced."""
    df.write.mode("errorifexists").parquet(path)


def write_csv(df: DataFrame, path: str, quote_all: bool = True, bom: bool = False) -> None:
    if bom:
        df = df.toDF("\ufeff" + df.columns[0], *df.columns[1:])
    df.write.mode("errorifexists").option("quoteAll", quote_all).option("escape", '"').csv(path, header=True)


def write_index(index: LexicalIndex, path: str) -> None:
    """Postings in term order: a reader that filters on query terms skips all other row groups.

    A term found in a third of all documents spans several files, since the range split is on
    (term, document).
    """
    ordered = index.postings.repartitionByRange("term", index.key).sortWithinPartitions("term", index.key)
    ordered.write.mode("errorifexists").parquet(f"{path}/postings")
    index.terms().repartitionByRange("term").sortWithinPartitions("term").write.mode("errorifexists").parquet(f"{path}/terms")
    index.totals.write.mode("errorifexists").parquet(f"{path}/totals")


def read_index(spark: SparkSession, path: str, key: str) -> LexicalIndex:
    return LexicalIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/totals"), key)


def write_manifest(spark: SparkSession, artifacts: dict[str, str], path: str, version: str) -> dict:
    """One JSON manifest: rows, bytes and a hash over the sorted file hashes of each artifact."""
    entries = {}
    for name, location in sorted(artifacts.items()):
        files = file_hashes(spark, location, "*.parquet")
        total = files.agg(
            F.count("*").alias("files"),
            F.sum("n_bytes").alias("bytes"),
            F.sha2(F.array_join(F.sort_array(F.collect_list("sha256")), "\n"), 256).alias("sha256"),
        ).first()
        entries[name] = {**total.asDict(), "rows": spark.read.parquet(location).count()}
    manifest = {
        "version": version,
        "created_at": datetime.now(timezone.utc).isoformat(timespec="seconds"),
        "artifacts": entries,
    }
    line = spark.createDataFrame([(json.dumps(manifest, sort_keys=True, ensure_ascii=False),)], "value string")
    line.coalesce(1).write.mode("errorifexists").text(path)
    return manifest


def reconcile_manifest(spark: SparkSession, manifest: dict, artifacts: dict[str, str]) -> list[str]:
    """Names whose stored rows differ from the manifest or that only one side knows."""
    problems = sorted(set(manifest["artifacts"]) ^ set(artifacts))
    for name in sorted(set(manifest["artifacts"]) & set(artifacts)):
        if spark.read.parquet(artifacts[name]).count() != manifest["artifacts"][name]["rows"]:
            problems.append(name)
    return problems


def write_event_lines(events: DataFrame, path: str) -> None:
    """One JSON object per line."""
    events.select(F.to_json(F.struct(*events.columns)).alias("value")).write.mode("errorifexists").text(path)
