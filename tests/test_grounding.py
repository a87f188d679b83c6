import pytest
from pyspark.sql import functions as F

from seekgrain.functions import text as tx
from seekgrain.operators import grounding, trusted

SUPPORT = "The team supported Alpha Bank with an audit of processes. 12,5 % of 40 sites were covered in 2021."


CASES = {
    # name: (text, options, codes that must appear, codes that must not)
    "path": ("See C:\\files\\x", {}, {"INTERNAL_PATH"}, set()),
    "score": ("Selected with a bm25 score", {}, {"RETRIEVAL_SCORE"}, set()),
    "chunk": ("Taken from chunk_id 3", {}, {"INTERNAL_CHUNK_ID"}, set()),
    "number": ("Covered 77 sites", {}, {"UNSUPPORTED_NUMBER"}, set()),
    "percentage": ("Covered 90 % of sites", {}, {"UNSUPPORTED_PERCENTAGE"}, set()),
    "year": ("Audit in 2019", {}, {"UNSUPPORTED_YEAR"}, set()),
    "country": ("Audit in Morocco", {}, {"UNSUPPORTED_COUNTRY"}, set()),
    "own country": ("Audit in Tunisia", {}, set(), {"UNSUPPORTED_COUNTRY"}),
    "technology": ("Audit with Kubernetes", {}, {"FABRICATED_TECHNOLOGY"}, set()),
    "name": ("Audit for Omega Holding", {}, {"UNSUPPORTED_NAMED_ENTITY"}, set()),
    "expansion": ("Audit by a strong operations team (SOT)", {}, {"UNSUPPORTED_ACRONYM_EXPANSION"}, set()),
    "done": ("The audit was delivered", {}, {"UNSUPPORTED_COMPLETION_LANGUAGE"}, set()),
    "headline": ("Audit delivered", {"field": "references[r1].headline"}, set(), {"UNSUPPORTED_COMPLETION_LANGUAGE"}),
    "roi": ("A clear return on investment", {}, {"UNSUPPORTED_ROI"}, set()),
    "award": ("It won an award", {}, {"UNSUPPORTED_AWARD"}, set()),
    "certified": ("A certified team", {}, {"UNSUPPORTED_CERTIFICATION"}, set()),
    "success": ("It was réussi", {}, {"UNSUPPORTED_SUCCESS_CLAIM"}, set()),
    "outcome": ("It resulted in growth", {}, {"UNSUPPORTED_CLIENT_OUTCOME"}, set()),
    "savings": ("Large cost savings", {}, {"UNSUPPORTED_FINANCIAL_OUTCOME"}, set()),
    "weak": ("Audit of processes", {}, {"WEAK_SOURCE_SUPPORT"}, {"MISSING_SUPPORT"}),
    "backed": ("Audit of processes for Alpha Bank covering 12.5% of sites", {"cited": ["C1"]}, set(), None),
    "promised": ("The audit was delivered", {"cited": ["P1"]}, {"PROPOSAL_SCOPE_AS_COMPLETED"}, set()),
    "other work": ("Migration and hosting platform delivered", {"cited": ["C1"]}, {"COMPLETION_DETAIL_NOT_ATTESTED"}, set()),
    "same work": ("Audit of processes delivered", {"cited": ["C1"]}, set(), None),
    "benefit": ("Happier customers everywhere", {"field": "references[r1].benefits[0]"}, {"UNSUPPORTED_BENEFIT"}, set()),
    "cautious": ("Strengthening audit processes somehow anyway", {"field": "references[r1].benefits[0]"}, set(), {"UNSUPPORTED_BENEFIT"}),
    "no support": ("Audit", {"cited": []}, {"MISSING_SUPPORT"}, set()),
    "foreign": ("Audit", {"cited": ["S2"]}, {"UNSELECTED_REFERENCE_SUPPORT", "WRONG_REFERENCE_SUPPORT"}, set()),
    "unknown": ("Audit", {"cited": ["S9"]}, {"UNKNOWN_SUPPORT_ID"}, set()),
    "empty": (" ", {}, {"EMPTY_TEXT_WITH_SUPPORT"}, {"WEAK_SOURCE_SUPPORT"}),
    "empty plan": ("Audit", {"planned": []}, {"EMPTY_SUPPORT_PLAN_VIOLATION"}, set()),
    "other plan": ("Audit", {"planned": ["S2"]}, {"PROVENANCE_PLAN_MISMATCH"}, set()),
    "section": ("A market leader", {"reference": None, "field": "introduction"}, {"UNSUPPORTED_PORTFOLIO_SUPERLATIVE"}, set()),
}


@pytest.fixture(scope="module")
def codes(spark):
    rows = [
        (name, o.get("reference", "r1"), o.get("field", "references[r1].realisations[0]"), text, o.get("cited", ["S1"]), o.get("planned"))
        for name, (text, o, _, _) in CASES.items()
    ]
    claims = spark.createDataFrame(
        rows, "claim_id string, reference_id string, field_path string, text string, support_ids array<string>, planned_ids array<string>"
    )
    supports = spark.createDataFrame(
        [
            ("S1", "r1", ["STRUCTURED_METADATA"], SUPPORT),
            ("C1", "r1", ["COMPLETED_WORK_EVIDENCE"], SUPPORT),
            ("P1", "r1", ["PROPOSAL_SCOPE"], SUPPORT),
            ("S2", "r2", ["STRUCTURED_METADATA"], "other"),
        ],
        "support_id string, reference_id string, support_types array<string>, text string",
    )
    selected = spark.createDataFrame([("r1",)], "reference_id string")
    facts = spark.createDataFrame([("r1", "Tunisie Retail")], "reference_id string, fact_text string")
    found = {name: set() for name in CASES}
    for row in grounding.validate_claims(claims, supports, selected, facts).collect():
        found[row.claim_id].add(row.code)
    return found


@pytest.mark.parametrize("name", CASES)
def test_claim_rules(codes, name):
    _, _, present, absent = CASES[name]
    assert present <= codes[name]
    assert codes[name] == set() if absent is None else not (absent & codes[name])


def test_numbers(value):
    assert value(grounding.numbers, "12,5 % of 40, v2 and 1.5") == ["12.5%", "40", "1.5"]


def test_field_plan(spark):
    rows = [
        ("r1", "S1", ["FACT"], "Title", "mission_title"),
        ("r1", "S2", ["FACT"], "Client", "client"),
        ("r1", "S3", ["CLIENT_ATTESTATION", "COMPLETED_WORK_EVIDENCE"], "A result was reached", None),
        ("r1", "S4", ["CONTRACTUAL_SCOPE"], "The main risk", None),
        ("r1", "S5", ["STRUCTURED_METADATA"], "Scope", None),
    ]
    table = spark.createDataFrame(rows, "reference_id string, support_id string, support_types array<string>, text string, fact_field string")
    plan = {}
    for row in grounding.field_plan(table).orderBy("field", "position").collect():
        plan.setdefault(row.field, []).append(row.support_id)
    assert plan["headline"] == ["S1", "S2"] and plan["short_description"] == ["S1", "S2", "S3"]
    assert plan["challenge"] == ["S4"] and plan["benefits"] == ["S3"] and plan["realisations"] == ["S3"]
    assert plan["why_relevant"] == ["S1", "S5"]


def test_reference_set(spark):
    got = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (2, "a", 1), (2, "z", 2)], "draft_id int, reference_id string, position int")
    asked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 2), (2, "b", 3)], "draft_id int, reference_id string, position int")
    rows = {(r.draft_id, r.code) for r in grounding.reference_set_findings(got, asked).collect()}
    assert rows == {(1, "REFERENCE_ORDER_CHANGED"), (2, "UNSELECTED_REFERENCE"), (2, "MISSING_SELECTED_REFERENCE")}


def test_fragments_and_excerpt(spark):
    text = "Je soussigné atteste que le projet a couvert trois sites; Audit complet du réseau • audit complet du réseau\nFait à Tunis"
    row = spark.createDataFrame([(text,)], "t string").select(trusted.safe_fragments(F.col("t"), 80).alias("f")).first()
    assert row.f == ["le projet a couvert trois sites", "Audit complet du réseau"]
    joined = spark.createDataFrame([(row.f,)], "f array<string>").select(trusted.excerpt(F.col("f"), 40).alias("e")).first()
    assert joined.e == "le projet a couvert trois sites"


def test_severities_and_richness(spark):
    rows = spark.createDataFrame([("r", "X", "WARNING"), ("r", "Y", "odd")], "reference_id string, code string, severity string")
    assert tuple(grounding.severity_counts(rows, "reference_id").first()) == ("r", 1, 1, 0, False)
    levels = spark.createDataFrame([(3, 0, 0), (0, 2, 0), (0, 0, 239)], "a int, s int, n int")
    got = [r.r for r in levels.select(grounding.richness(F.col("a"), F.col("s"), F.col("n")).alias("r")).collect()]
    assert got == ["RICH", "MEDIUM", "SPARSE"]


HINTED = [
    "Réussite du projet", "AVEC SUCCÈS", "LE CLIENT A OBTENU", "dıstınctıon", "ISO9001", "iso 27001", "100%award", "²ROI", "™PRIZE", "Économies",
    "mises en œuvre", "Livrés", "تم تنفيذ", "prıze", "prıſe certıfıed", "Mise en place", "augmentation des revenus", "PMP", "nothing here",
]


def test_hints_pass_every_text_a_pattern_matches(spark):
    """Without its hint a text is not searched, so no match may lack it."""
    rows = spark.createDataFrame([(t,) for t in HINTED], "text string")
    said = grounding._spoken(grounding.phrase_words(F.col("text")))
    joined = F.contains("text", F.lit("%")) | F.regexp_like("text", F.lit(grounding.JOINING_SIGNS))
    patterns = {p: h for p, h in grounding.HINTS.items() if p != grounding.LEAK_PATTERNS["RETRIEVAL_SCORE"]}
    checks = [
        F.struct(F.regexp_like("text", F.lit(p)).alias("match"), (joined | grounding._hinted(said, h.split())).alias("hint"))
        for p, h in patterns.items()
    ]
    found = [(r["text"], c["match"], c["hint"]) for r in rows.select("text", F.array(*checks).alias("c")).collect() for c in r["c"]]
    assert len({text for text, match, _ in found if match}) >= 15
    assert not [text for text, match, hint in found if match and not hint]


def test_names_of_a_long_heading(spark):
    """A run of thousands of capitalised words is one name and takes no stack frame for each word."""
    text = "Omega " + "Holding " * 30000 + "J. went"
    frame = spark.createDataFrame([(text,)], "text string")
    name = F.regexp_extract_all("text", F.lit(grounding.NAME_PATTERN), F.lit(0))
    person = F.regexp_extract_all(F.concat(F.lit("Mr "), "text"), F.lit(grounding.PERSON_PATTERN), F.lit(0))
    row = frame.select(name.alias("n"), person.alias("p")).first()
    assert [len(n) for n in row["n"]] == [len("Omega " + "Holding " * 30000) - 1]
    assert [len(p) for p in row["p"]] == [len("Mr " + text)]


def test_words_of_brief_texts_are_those_of_the_text(spark):
    frame = spark.createDataFrame([("Alpha beta\nalpha Beta-gamma ’alpha é É beta  x% 12 beta",)], "text string")
    row = frame.select(
        grounding.phrase_words(F.col("text")).alias("a"),
        F.array_distinct(F.split(F.trim(grounding.phrase_form(F.col("text"))), " ")).alias("b"),
    ).first()
    assert row["a"] == row["b"]


def test_fragments_are_looked_up_in_no_list(spark):
    """Equal fragments are found by sorting: 30,000 of one text took minutes as a growing list."""
    text = "; ".join(f"Audit of the site number {i % 15000}" + ("" if i < 15000 else " ") for i in range(30000))
    frame = spark.createDataFrame([(text,), ("Alpha beta gamma; ALPHA BETA GAMMA; delta  epsilon zeta; alpha beta gamma",), (None,)], "t string")
    found = [r.f for r in frame.select(trusted.safe_fragments(F.col("t"), 80).alias("f")).collect()]
    assert found[0] == [f"Audit of the site number {i}" for i in range(15000)]
    assert found[1] == ["Alpha beta gamma", "delta epsilon zeta"]
    plan = frame.select(trusted.safe_fragments(F.col("t"), 80).alias("f"))._jdf.queryExecution().optimizedPlan().toString()
    assert "kept" not in plan


def test_boilerplate_across_blanks_is_found_in_its_fragment(spark):
    text = "En foi  de quoi nous signons ici; un audit complet; attestation  du client, le projet  a couvert dix sites"
    row = spark.createDataFrame([(text,)], "t string").select(trusted.safe_fragments(F.col("t"), 80).alias("f")).first()
    assert row.f == ["un audit complet", "le projet a couvert dix sites"]


def test_lineage_is_told_from_the_first_characters(spark):
    names = ["", " \n\u00a0", "n/a", " NaN\t", "None ", "#VALUE!", "n / a", "nano", "x", None, "na na", "\u2003null\u2003"]
    rows = spark.createDataFrame([(n,) for n in names], "t string")
    text = F.coalesce("t", F.lit(""))
    got = rows.select((tx.clean("t") == "").alias("a"), F.regexp_like(text, F.lit(trusted.MISSING)).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got]


def test_a_passage_is_checked_once_for_all_its_links(spark):
    """Texts of passages do not meet the links: no join after the checks carries them."""
    passages = spark.createDataFrame(
        [("c1", "d", "f", "a" * 64, 1, "p", "u", "text", True, True, "INTERNAL"), ("c2", "d", "f", "b" * 64, 1, "p", "n/a", "text", True, True, "INTERNAL")],
        "chunk_id string, document_id string, source_file_name string, source_sha256 string, page_number_1_based int, citation_label string, "
        "citation_uri string, display_text string, approved_for_retrieval boolean, approved_for_display boolean, security_classification string",
    )
    references = spark.createDataFrame([("R1", 1, True), ("R2", 2, True), ("R3", 3, True)], "reference_id string, row_number int, document_retrieval_eligible boolean")
    links = spark.createDataFrame([("c1", 1), ("c2", 2)], "chunk_id string, row_number int")
    found = trusted.rejection_codes(references, passages, links, links.select("row_number").filter("false"), ["INTERNAL"])
    assert dict(map(tuple, found.collect())) == {"R1": None, "R2": "INVALID_SOURCE_LINEAGE", "R3": "REFERENCE_WITHOUT_EVIDENCE"}
    assert "display_text" not in found._jdf.queryExecution().optimizedPlan().toString()
