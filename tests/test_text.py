import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from seekgrain.functions import language, lists, text as tx
from seekgrain.functions import vocabulary as vocab
from seekgrain.functions.unicode_rules import ARABIC_LETTERS, ARABIC_MARK_RANGES


def expected_fold(text):
    folded = unicodedata.normalize("NFKC", text).casefold().replace("ـ", "")
    kept = [c for c in folded if not any(a <= ord(c) <= b for a, b in ARABIC_MARK_RANGES)]
    mapped = "".join(ARABIC_LETTERS.get(c, c) for c in kept)
    return "".join(c for c in unicodedata.normalize("NFKD", mapped) if not unicodedata.combining(c))


def test_fold_equals_unicode_definition(spark):
    rng = random.Random(7)
    pool = [chr(c) for c in (*range(0x20, 0x3000), *range(0xAC00, 0xAC80), *range(0xF900, 0xFFF0), *range(0x1D400, 0x1D500))]
    pool = [c for c in pool if unicodedata.category(c) not in ("Cn", "Cs", "Co")]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    texts += ["Sécurité française", "Straße … ﬁn ½ ℃", "كِتَابٌ إلى ـــ مؤسسة", "한국어 TEXT", "ŉ ǰ ĳ ﬀ", ""]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in frame.select("t", tx.fold("t").alias("f")).collect():
        assert row.f == expected_fold(row.t)


def test_compatible_composes(value):
    assert value(tx.compatible, "e\u0301te\u0301 ﬁn ①") == "été fin 1"


def test_tokens(value):
    assert value(tx.tokens, "Sécurité française, a x1!") == ["securite", "francaise", "x1"]
    assert value(tx.tokens, "إلى الأعمال") == ["الي", "الاعمال"]


@pytest.mark.parametrize("raw,clean", [(" N/A ", ""), ("#VALUE!", ""), (" a \t b ", "a b"), ("Nan", ""), ("nana", "nana")])
def test_null_words(value, raw, clean):
    assert value(tx.clean, raw) == clean


def test_facet_key(value):
    assert value(tx.facet_key, " Côte d’Ivoire ") == "cote d ivoire"


def test_phrase_needs_whole_tokens(value):
    assert not value(lambda t: tx.has_phrase(tx.tokens(t), "api"), "A capital planning exercise")
    assert value(lambda t: tx.has_phrase(tx.tokens(t), "api gateway"), "Our API  Gateway project")


def test_labels_match_substrings(value):
    found = value(lambda t: tx.matching_labels(t, vocab.TECHNOLOGY_LABELS), "Disappeared data warehouse and ERP project")
    assert found == ["Data platform", "ERP"]
    assert value(lambda t: tx.matching_labels(t, vocab.TECHNOLOGY_LABELS), "Disappear") == ["ERP"]


def test_json_strings(value):
    assert value(tx.json_strings, '["Été", "ete", " a  b ", null, ""]') == ["Été", "a b"]
    assert value(tx.json_strings, "plain") == ["plain"]
    assert value(tx.json_strings, "7") == ["7"]
    assert value(tx.json_strings, None) == []


@pytest.mark.parametrize(
    "text,language_name,mixed",
    [
        ("Le projet de la banque pour les clients", "fr", False),
        ("The project of the bank is for clients", "en", False),
        ("مشروع استمرارية الاعمال للبنك", "ar", False),
        ("مشروع cloud للبنك", "mixed", True),
        ("12345 !!", "und", False),
    ],
)
def test_language(value, text, language_name, mixed):
    found = value(language.analyze, text)
    assert (found.detected_language, found.mixed_script) == (language_name, mixed)


def test_target_language(value):
    french = "Le client est dans la région et les équipes sont avec nous pour la mission"
    assert value(lambda t: language.target_check(t, "fr"), french) == "PASS"
    assert value(lambda t: language.target_check(t, "en"), french) == "CLEAR_MISMATCH"
    assert value(lambda t: language.target_check(t, "fr"), "SAP ERP 2020") == "UNCERTAIN"
    assert value(lambda t: language.target_check(t, "ar"), "مشروع استمرارية الاعمال للبنك المركزي الوطني") == "PASS"


def test_unique_items_drops_near_copies(spark):
    items = ["Audit des processus métier", "Audit du processus métier", "Déploiement réseau", "", "déploiement  RÉSEAU"]
    frame = spark.createDataFrame([(items,)], "v array<string>")
    assert frame.select(lists.unique_items(F.col("v")).alias("u")).first().u == [items[0], items[2]]


def test_strip_looks_at_the_ends_only(spark, value):
    spaces = tx.SPACES
    assert value(lambda t: F.regexp_replace(t, tx.SPACE, ""), "".join(map(chr, range(1, 0x3100)))) == "".join(
        chr(c) for c in range(1, 0x3100) if chr(c) not in spaces
    )
    for text in (spaces + "a" + spaces + "b  c d" + spaces, spaces, "", "a\u200bb", "\u200b a \n"):
        by_pattern = value(lambda t: F.regexp_replace(t, f"^{tx.SPACE}+|{tx.SPACE}+$", ""), text)
        assert value(tx.strip, text) == by_pattern
        runs = value(lambda t: F.regexp_replace(F.regexp_replace(t, f"{tx.SPACE}+", " "), "^ | $", ""), text)
        assert value(tx.squeeze, text) == runs
    plan = spark.range(1).select(tx.strip(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()
    assert "regexp" not in plan
