"""Repairs of copy, entailed and anchored texts, and supports with equal evidence, against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from seekgrain.functions import repairs
from seekgrain.operators import anchors, support_links

ECHOES = {
    "Mise en place du plan, mise en place": "Mise en place du plan",
    "Étude du marché puis etude": "Étude du marché puis",
    "un deux un": "un deux un",
    "a  b c d e": "a b c d e",
    "a b c d a b": "a b c d",
    "خطة العمل في المدينة الكبيرة": "خطة العمل في",
    "": "",
}
ENDS = {
    "Appui à la mise en place de la ": "Appui à la mise en place",
    "plan, et, de": "plan",
    "dela": "dela",
    "la": "",
    "as well as": "",
    "Work and results, as  well as": "Work and results",
    "plan ;": "plan ;",
    "Suivi des": "Suivi",
    "plan et chat": "plan et chat",
    "formation d'": "formation",
}
PERSONS = {
    "Audit mené par un expert (M. Dupont, chef) en 2020 .": "Audit mené en 2020.",
    "Plan validé (Mme Durand) ; fin": "Plan validé; fin",
    "Revue par Dr Martin, directeur. Suite": "Revue . Suite".replace(" .", "."),
    "Rien à dire": "Rien à dire",
}
PHASES = {
    "Rédaction du plan (phase 2 : tests) ;": "Rédaction du plan",
    "Essai du plan (phase 2 : tests)": "Essai du plan (phase 2 : tests)",
    "A (phase 1: test) B (étape 2: test)": "A (phase 1: test) B (étape 2: test)",
}


@pytest.mark.parametrize("text", ECHOES)
def test_echo(value, text):
    assert value(repairs.without_echo, text) == ECHOES[text]


@pytest.mark.parametrize("text", ENDS)
def test_dangling_end(value, text):
    assert value(repairs.without_dangling_end, text) == ENDS[text]


def test_long_chain_of_connectors_is_fast(value):
    assert value(repairs.without_dangling_end, "plan" + "  de   la ,;" * 20_000) == "plan"
    assert value(repairs.without_dangling_end, "de   la ,; " * 2_000 + "plan").endswith("plan")


@pytest.mark.parametrize("text", PERSONS)
def test_persons(value, text):
    assert value(repairs.without_persons, text) == PERSONS[text]


@pytest.mark.parametrize("text", PHASES)
def test_phase_label(value, text):
    assert value(repairs.without_orphan_phase, text) == PHASES[text]


def test_foreign_letters(value):
    assert value(lambda t: repairs.without_foreign_letters(t, F.lit("fr")), "Plan 计划 d’été, план") == "Plan d’été"
    assert value(lambda t: repairs.without_foreign_letters(t, F.lit("en")), " Plan план ") == "Plan план"


def test_expansions(value):
    scope = F.lit("Mise en place du PCA, PHASE 2")
    assert value(lambda t: repairs.without_guessed_expansions(t, scope), "Test du PCA (Plan de Continuité)") == "Test du PCA"
    got = value(lambda t: repairs.without_guessed_expansions(t, scope), "Définition du plan de continuité (PCA) et DSI (x y z)")
    assert got == "Définition du PCA et DSI (x y z)"


def test_null_texts(value):
    for repair in (repairs.without_echo, repairs.without_dangling_end, repairs.without_persons, repairs.without_orphan_phase):
        assert value(repair, None) is None
    assert value(lambda t: repairs.without_guessed_expansions(t, t), None) is None


def test_entailment(spark):
    trusted = [(1, "Refonte du réseau bancaire"), (1, "Difficulté de pilotage"), (2, "Audit"), (3, None)]
    asked = [
        (1, 1, "refonte reseau bancaire"), (1, 2, "refonte marketing boutique"), (1, 3, "Difficulté du réseau"),
        (2, 1, "Difficulté audit"), (2, 2, "Adapté aux spécificités audit"), (3, 1, "alpha bravo"), (3, 2, None),
        (None, 1, "alpha bravo"), (9, 1, "alpha bravo"),
    ]
    got = anchors.entailment(
        spark.createDataFrame(asked, "k int, n int, t string"), ["k", "n"], "t",
        spark.createDataFrame(trusted, "k int, s string"), "k", "s", applies=~F.col("k").eqNullSafe(9),
    )
    found = {(r.k, r.n): (r.n_words, r.n_unknown, r.entailed) for r in got.collect()}
    assert found == {
        (1, 1): (3, 0, True), (1, 2): (3, 2, False), (1, 3): (2, 0, True), (2, 1): (2, 0, False), (2, 2): (3, 2, False),
        (3, 1): (2, 2, False), (3, 2): (0, 0, True), (None, 1): (0, 0, True), (9, 1): (2, 2, True),
    }


def test_anchors_equal_a_walk_over_all_pairs(spark):
    rng = random.Random(4)

    def word():
        return "".join(rng.choice("ab") for _ in range(rng.choice([2, 3, 4, 5, 6, 7, 39, 40, 41, 43])))

    base = ["ab" * 21, "ab" * 21 + "a", "ab" * 20, "the"]
    trusted = [(k, " ".join([word(), rng.choice(base)] if rng.random() < 0.5 else [word()])) for k in range(60)]
    asked = [(k, n, " ".join([word(), rng.choice(base)] if rng.random() < 0.5 else ["12", word()])) for k in range(60) for n in range(4)]
    got = anchors.anchored(
        spark.createDataFrame(asked + [(1, 9, None), (None, 1, "the")], "k int, n int, t string"), ["k", "n"], "t",
        spark.createDataFrame(trusted, "k int, s string"), "k", "s", dropped=["the"],
    )
    held = {k: set(s.split()) - {"the"} for k, s in trusted}

    def meets(v, s):
        return v == s or (min(len(v), len(s)) >= 5 and (v.startswith(s) or s.startswith(v)))

    want = {(k, n): any(meets(v, s) for v in set(t.split()) - {"the", "12"} for s in held[k]) for k, n, t in asked}
    found = {(r.k, r.n): r.anchored for r in got.collect()}
    assert found == {**want, (1, 9): False, (None, 1): False}
    assert 20 < sum(want.values()) < 220


def test_anchors_move_no_copies_of_trusted_words(spark):
    def rows_of(stage, words):
        trusted = spark.createDataFrame([(1, words)], "k int, s string")
        asked = spark.createDataFrame([(1, 1, "words")], "k int, n int, t string")
        return stage(asked, ["k", "n"], "t", trusted, "k", "s")

    for stage in (anchors.anchored, anchors.entailment):
        plan = rows_of(stage, "wordsmith of it")._jdf.queryExecution().analyzed().toString()
        # Operators are listed before their inputs: what is dealt out over slices is what both sides hold.
        above, below = plan.split("explode(sequence(0, 7", 1)
        assert "LeftSemi" in below and "explode(sequence(0, 7" not in below
    assert rows_of(anchors.anchored, "wordsmith of it").first().anchored
    assert not rows_of(anchors.anchored, "word of it").first().anchored


@pytest.mark.parametrize("asked, held, want", [
    ("x" * 50, "x" * 45, True), ("x" * 45, "x" * 50, True), ("x" * 50, "x" * 40, True), ("x" * 40, "x" * 50, True),
    ("x" * 44 + "a", "x" * 44 + "b", False), ("abcdef", "abcde abcdea", True), ("abcde", "abcdz abcdef abcdeg", True), ("abcd", "abcde", False),
])
def test_anchors_of_any_length(spark, asked, held, want):
    texts = spark.createDataFrame([(1, 1, asked)], "k int, n int, t string")
    trusted = spark.createDataFrame([(1, held), (None, asked)], "k int, s string")
    assert anchors.anchored(texts, ["k", "n"], "t", trusted, "k", "s").first().anchored == want


def test_value(value):
    assert value(lambda t: anchors.tells_value(t, F.lit("fr")), "Renforcement du pilotage")
    assert not value(lambda t: anchors.tells_value(t, F.lit("fr")), "Renforcement de 20 %")
    assert not value(lambda t: anchors.tells_value(t, F.lit("en")), "Renforcement du pilotage")
    assert not value(lambda t: anchors.tells_value(t, F.lit("en")), None)


def test_equal_evidence(spark, monkeypatch):
    texts = ["a" * 50, "b" * 50, "", None]
    supports = [(i, i % 3 or None, texts[i % 4]) for i in range(24)]
    evidence = [(100 - i, i % 3, texts[i % 3]) for i in range(30)]
    shown = [spark.createDataFrame(r, "id long, page int, t string") for r in (supports, evidence)]

    def found():
        rows = support_links.first_equal_evidence(shown[0], "id", shown[1], "id", ["page"], "t").collect()
        return {r.id: r.evidence_id for r in rows}

    want = {
        i: min((e for e, p, s in evidence if page is not None and t is not None and (p, s) == (page, t)), default=None)
        for i, page, t in supports
    }
    assert found() == want and any(want.values())
    # Fingerprints that say nothing leave the work to the comparison.
    monkeypatch.setattr(support_links.F, "xxhash64", lambda *_: F.lit(1).cast("long"))
    assert found() == want
