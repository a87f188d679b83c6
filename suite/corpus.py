"""The retrieval model laid over the given tables.

``documents`` are the passages, ``part`` is the reference catalog, and ``lineitem`` links a
document to the parts of the order with the same number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekgrain.operators import catalog
from seekgrain.plans.search import Corpus
from seekgrain.session import reliable_checkpoint, stored
from suite.base import Tables

CURRENT_YEAR = 2003
DOCUMENT_TYPES = ("ATTESTATION", "CONTRACT", "MINUTES", "OTHER_EVIDENCE", "SPECIFICATION")


def passage_table(t: Tables) -> DataFrame:
    # Only orders with the number of a document are gathered.
    orders = t.lineitem.join(t.documents.select(F.col("doc_id").alias("l_orderkey")), "l_orderkey", "left_semi")
    rows = (
        orders.groupBy("l_orderkey")
        .agg(F.to_json(F.sort_array(F.collect_set("l_partkey"))).alias("reference_rows_json"))
        .withColumnRenamed("l_orderkey", "doc_id")
    )
    kinds = F.array(*[F.lit(k) for k in DOCUMENT_TYPES])
    return (
        t.documents.join(rows, "doc_id", "left")
        .join(t.labels, "doc_id", "left")
        .join(t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
        .select(
            F.col("doc_id").alias("chunk_id"),
            F.col("text").alias("chunk_text"),
            F.lit(None).cast("string").alias("display_text"),
            F.col("lang").alias("document_language"),
            F.get(kinds, F.pmod("n_chars", F.lit(5)).cast("int")).alias("document_type"),
            F.col("source").alias("source_file_name"),
            F.lit(1).alias("page_number_1_based"),
            F.concat(F.lit("doc://"), F.col("doc_id")).alias("citation_uri"),
            F.concat(F.col("source"), F.lit(", p. 1")).alias("citation_label"),
            F.when(F.coalesce("toxic", F.lit(0)) == 1, "RESTRICTED").otherwise("Internal").alias(
                "security_classification"
            ),
            (F.coalesce("quality", F.lit(1)) == 1).alias("approved_for_display"),
            F.lit(True).alias("approved_for_retrieval"),
            F.coalesce("reference_rows_json", F.lit("[]")).alias("reference_rows_json"),
            "embedding",
        )
    )


def reference_table(t: Tables) -> DataFrame:
    years = t.lineitem.groupBy("l_partkey").agg(
        F.min(F.year("l_shipdate")).alias("y0"), F.max(F.year("l_shipdate")).alias("y1")
    )
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    about = t.documents.select(F.col("doc_id").alias("p_partkey"), F.col("text").alias("about"))
    return (
        t.part.join(years, F.col("p_partkey") == F.col("l_partkey"), "left")
        .join(places, F.pmod("p_partkey", F.lit(25)) == F.col("n_nationkey"), "left")
        .join(about, "p_partkey", "left")
        .select(
            F.format_string("R%09d", "p_partkey").alias("reference_id"),
            F.col("p_partkey").cast("int").alias("row_number"),
            F.col("p_partkey").cast("string").alias("reference_number"),
            F.concat_ws(" ", "p_name", "about").alias("service_nature"),
            F.col("p_type").alias("offering"),
            F.col("p_brand").alias("client"),
            F.col("n_name").alias("country"),
            F.col("r_name").alias("sector"),
            F.when(F.col("p_size") > 25, "Large").otherwise("n/a").alias("business_unit"),
            F.when(F.col("y0").isNull(), "n/a")
            .when(F.col("y1") >= CURRENT_YEAR - 1, F.concat("y0", F.lit(" - en cours")))
            .otherwise(F.concat_ws("-", "y0", "y1"))
            .alias("project_year"),
            F.when(F.col("p_size") % 2 == 0, "Attestation").otherwise("Sans JUSTIF").alias("attestation_available"),
            F.lit("OK").alias("data_quality_status"),
            F.lit(True).alias("evidence_available"),
            (F.col("p_size") > 5).alias("document_retrieval_eligible"),
        )
    )


def corpus(t: Tables) -> Corpus:
    passages, references = stored(passage_table(t)), reference_table(t)
    links = reliable_checkpoint(catalog.bridge(passages, references, "chunk_id"))
    normalized = stored(
        catalog.normalize_references(references, links, passages, "chunk_id", CURRENT_YEAR)
    )
    return Corpus(passages, normalized, links)


def search_queries(t: Tables) -> DataFrame:
    """Benchmark texts; the stored vector with the same id stands for the encoded query."""
    vectors = t.embeddings.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("query_vector"))
    return t.benchmark.join(vectors, "item_id", "left").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query_text"), "query_vector"
    )
