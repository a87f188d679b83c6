"""Field counts of one search against those of the whole index, and what is left out without changing an answer."""

from pyspark.sql import functions as F

from seekgrain.functions import vocabulary as vocab
from seekgrain.operators import fields, lexical
from seekgrain.session import stored

KNOWN = [p for p, _, _ in vocab.PHRASES]


def test_asked_counts_are_those_of_the_whole_index(spark):
    rows = [(1, "API gateway for a bank bank", True), (1, "API gateway for a bank bank", True), (2, "bank audit", True),
            (3, "bank bank", False), (4, None, True), (None, "bank", True), (5, "", True)]
    docs = spark.createDataFrame(rows, "chunk_id long, chunk_text string, ok boolean")
    links = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "b"), (4, "b"), (5, "c")], "chunk_id long, reference_id string")
    own = spark.createDataFrame(
        [("a", "title", "Core banking at a bank"), ("a", "title", "Core banking"), ("b", "title", ""), ("b", "client", "Audit AG")],
        "reference_id string, field string, text string",
    )
    asked = spark.createDataFrame([(1, "bank"), (2, "audit"), (2, "unheard")], "q int, term string")

    valid = docs.filter("ok")
    whole = fields.field_tokens(own, "reference_id").unionByName(fields.evidence_tokens(valid, links, "chunk_id", "chunk_text"))
    spoken = fields.field_phrases(own, ["reference_id", "field"], "text").unionByName(
        fields.field_phrases(valid, ["chunk_id"], "chunk_text").join(links, "chunk_id")
        .select("reference_id", F.lit("evidence").alias("field"), "term").distinct()
    )
    index = lexical.build_index(docs, "chunk_id", "chunk_text", asked, F.col("ok"), KNOWN)
    plain = lexical.build_index(docs, "chunk_id", "chunk_text", asked)
    counts = fields.asked_counts(own, index.counted, links, asked, KNOWN, "chunk_id", True)
    terms, phrases, lengths = fields.told_apart(counts)

    def listed(frame, *columns):
        return sorted(map(tuple, frame.select(*columns).collect()), key=str)

    key = ("reference_id", "field")
    assert listed(terms, *key, "term", "tf") == listed(whole.join(asked, "term", "left_semi"), *key, "term", "tf")
    assert listed(lengths, *key, "length") == listed(whole.groupBy(*key).agg(F.sum("tf").alias("length")), *key, "length")
    assert listed(phrases, *key, "term") == listed(spoken, *key, "term")
    assert ("a", "evidence", "api gateway") in listed(phrases, *key, "term")
    assert listed(index.postings, *plain.postings.columns) == listed(plain.postings, *plain.postings.columns)
    assert listed(index.totals, "*") == listed(plain.totals, "*")


def test_leading_references_place_the_same_passages(spark):
    scores = [(q, f"r{i}", ((i * 37 + q * 11) % 101) / 10 + (i % 3) * 0.001) for q in (1, 2) for i in range(300)] + [(3, "r7", 0.5)]
    links = [(c, f"r{(c * k * 7 + k) % 300}") for c in range(400) for k in range(1, 4)]
    scores = spark.createDataFrame(scores, "q int, reference_id string, score double")
    links = spark.createDataFrame(links, "chunk_id long, reference_id string").distinct()
    whole = fields.project_to_passages(scores, links, "q", "chunk_id")
    leading = fields.leading_references(scores, links, "q", "chunk_id", 20)
    some = fields.project_to_passages(leading, links, "q", "chunk_id")
    assert leading.count() < scores.count() / 2

    def first(frame, n):
        rows = sorted(map(tuple, frame.collect()), key=lambda r: (r[0], -r[2], r[1]))
        return [r for q in (1, 2, 3) for r in [r for r in rows if r[0] == q][:n]]

    assert first(some, 20) == first(whole, 20)
    pairs = whole.filter("chunk_id % 9 = 0").select("q", "chunk_id")
    asked = fields.project_to_pairs(pairs, scores, links, "q", "chunk_id")
    assert first(asked, 999) == first(whole.filter("chunk_id % 9 = 0"), 999)


def test_matches_of_queries_with_many_terms(spark):
    words = [f"w{i:03d}" for i in range(150)]
    asked = [(1, w, "acronym" if i % 50 == 0 else "term") for i, w in enumerate(words)] + [(2, "w000", "term"), (2, "w149", "technology")]
    tokens = [("a", "title", w, 1) for w in words] + [("a", "evidence", "w149", 2), ("b", "client", "w000", 1)]
    tokens = spark.createDataFrame(tokens, "k string, field string, term string, tf long")
    asked = spark.createDataFrame(asked, "q int, term string, category string")
    everyone = spark.createDataFrame([("a",), ("b",)], "k string")
    for few in (True, False):
        matches = fields.exact_matches(tokens, everyone, asked, "q", "k", few)
        got = {(r.q, r.k, r.field): (r.terms, r.strong_terms) for r in matches.collect()}
        assert got[1, "a", "title"] == (words, ["w000", "w050", "w100"])
        assert got[2, "a", "title"] == (["w000", "w149"], ["w149"]) and got[2, "b", "client"] == (["w000"], [])
        scores = fields.score_fields(tokens, everyone, asked, "q", "k", few_query_terms=few)
        found = {(r.q, r.k): r for r in fields.combine(scores, matches, "q", "k").collect()}
        one, other = found[1, "a"], found[1, "b"]
        assert (one.strong_exact_term_count, one.technology_acronym_match_count, one.matched_fields) == (150, 3, ["evidence", "title"])
        assert (other.strong_exact_term_count, other.capability_field_support, other.matched_fields) == (0, 0, ["client"])


def test_supported_concepts_are_told_once_per_reference(spark):
    names = list(vocab.CONCEPT_EVIDENCE) + ["else"]
    texts = [["kong"], ["cloud", "security"], ["business", "continuity", "api"], []]
    rows = [(names[i : i + n], t) for i in range(5) for n in (0, 1, 2) for t in texts]
    frame = spark.createDataFrame(rows, "c array<string>, t array<string>")
    told = lexical.all_supported(F.col("c"), lexical.supported_concepts(F.col("t")))
    assert frame.filter(told != lexical.supports_concepts(F.col("c"), F.col("t"))).count() == 0


def test_stored_rows_have_no_lineage(spark):
    kept = stored(spark.range(50).groupBy((F.col("id") % 5).alias("k")).agg(F.collect_list("id").alias("ids")))
    assert kept.count() == 5 and kept.columns == ["k", "ids"]
    assert all(f.endswith(".parquet") for f in kept.inputFiles())
