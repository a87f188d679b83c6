from seekgrain.operators.reasons import match_reasons

SCHEMA = (
    "query_terms array<struct<term:string,display:string,category:string>>, exact_terms array<string>, offering string, "
    "sector string, service_nature string, best_dense double, query_language string, evidence_language string, "
    "display_text string, citation_label string, project_delivery_signal boolean"
)
TERMS = [("api", "API", "acronym"), ("banking", "banking", "term"), ("audit", "audit", "term")]


def reasons(spark, row, filters=None):
    frame = spark.createDataFrame([row], SCHEMA)
    return frame.select(match_reasons(filters).alias("r")).first().r


def test_reasons_in_order(spark):
    row = (TERMS, ["api", "audit"], "Audit", "Banking", "API audit", 0.8, "fr", "en", "text", "doc, p. 2", True)
    found = reasons(spark, row, {"country": ["France"], "period": (2020, 2024)})
    assert [r.category for r in found] == [
        "Confirmed technology or capability", "Matching offering", "Matching sector", "Matching capability",
        "Cross-language semantic match", "Confirmed delivery evidence", "Matching country/filter", "Matching period/filter",
    ]
    assert found[0]["values"] == ["API"] and found[3]["values"] == ["API", "audit"] and found[7]["values"] == ["2020–2024"]
    assert found[1].description == "Matches the requested Audit offering."


def test_fallback_uses_the_shown_text(spark):
    row = (TERMS, [], "x", "y", "z", 0.1, "fr", "fr", "An audit of capital", "doc", False)
    found = reasons(spark, row)
    assert [(r.category, r["values"]) for r in found] == [("Matching capability", ["audit"])]
    assert reasons(spark, (*row[:8], "nothing", *row[9:])) == []
