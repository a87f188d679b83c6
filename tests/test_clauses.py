"""Activity clauses against a plain walk, and how far other texts cover them."""

import re

import pytest
from pyspark.sql import functions as F

from seekgrain.functions import clauses
from suite import QUERIES

CASES = {
    "préparation du plan ; appui à la rédaction des tests": ["préparation du plan", "appui à la rédaction des tests"],
    "• Cadrage • Définition des besoins": ["Cadrage Définition des besoins"],
    "Étude de marché et pilotage du projet": ["Étude de marché et pilotage du projet"],
    "plan A ; plan B ; plan A": ["plan A", "plan B"],
    "seul": ["seul"],
    "plan directeur ; fin": ["plan directeur fin"],
    "; - : ;": [],
    "Mise  en place du PCA mise en place du PRA": ["Mise  en place du PCA", "mise en place du PRA"],
    "Diagnosticà part gestion des accès": ["Diagnosticà part", "gestion des accès"],
    "appui ; à la ; fin du lot": ["appui à la fin du lot"],
    "": [],
}


@pytest.mark.parametrize("text", CASES)
def test_clauses(value, text):
    assert value(clauses.activity_clauses, text) == CASES[text]


def test_null_text(value):
    assert value(clauses.activity_clauses, None) == []


def walk(pieces, limit):
    """The same rules over a list, one clause after the other."""
    done, open_ = [], ""
    for piece in pieces:
        clause = f"{open_} {piece}".strip()
        goes_on = len(clause.split()) < 2 or re.search(r"\b(et|appui à la)$", clause)
        open_ = clause if goes_on else ""
        if not goes_on:
            done.append(clause)
    if open_:
        done = [*done[:-1], f"{done[-1]} {open_}"] if done else [open_]
    done = list(dict.fromkeys(done))
    while len(done) > limit:
        sums = [len(a) + len(b) for a, b in zip(done, done[1:])]
        at = sums.index(min(sums))
        glue = " " if re.search(r"\b(et|à la)$", done[at]) else "; "
        done[at : at + 2] = [(done[at] + glue + done[at + 1])[:360]]
    return done


def test_many_clauses_are_joined_shortest_first(spark):
    words = ["lot", "un deux", "x", "a b et", "appui à la", "une étude longue", "c d", "a b", "jalon final du lot", "et"]
    rows = []
    for n in range(60):
        rows.append((n, [words[(n * 7 + k * k * (n % 5 + 1)) % len(words)] for k in range(n)]))
    rows.append((60, [f"clause {k} " + "w" * (k % 90) for k in range(120)]))
    frame = spark.createDataFrame([(n, " ; ".join(p)) for n, p in rows], "n int, text string")
    found = {r["n"]: r["c"] for r in frame.select("n", clauses.activity_clauses("text").alias("c")).collect()}
    for n, pieces in rows:
        assert found[n] == walk(pieces, clauses.CLAUSES), n


def test_long_clauses_are_cut(value):
    found = value(clauses.activity_clauses, "a " + "b" * 400 + "; c d")
    assert [len(c) for c in found] == [260, 3]


@pytest.mark.parametrize(
    "held, texts, expected",
    [
        (["rédaction du plan", "audit des comptes"], ["Redaction finale"], (2, 1, True)),
        (["rédaction du plan", "audit des comptes", "revue annuelle complète"], ["plan"], (3, 1, False)),
        (["un deux trois quatre cinq six"], ["six"], (1, 1, True)),
        (["alpha bravo charlie delta echo foxtrot"], ["alpha"], (1, 0, False)),
        (["projet avec les"], [], (0, 0, True)),
        (["audit des comptes"], [None, ""], (1, 0, False)),
        (None, None, (0, 0, True)),
    ],
)
def test_coverage(spark, held, texts, expected):
    frame = spark.createDataFrame([(held, texts)], "held array<string>, texts array<string>")
    row = frame.select(clauses.clause_coverage(F.col("held"), F.col("texts")).alias("c")).first()["c"]
    assert tuple(row) == expected


def tables(spark, folder):
    texts = [(1, "un plan ; audit des comptes thble revue annuelle"), (2, "seul"), (3, None), (4, "thblex reste ; the")]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(f"{folder}/documents.parquet")
    turns = [(1, "des comptes"), (1, None), (2, "seul"), (5, "plan")]
    spark.createDataFrame(turns, "conv_id bigint, text string").write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


def test_query_of_clauses(spark, tmp_path):
    rows = QUERIES["activity_clauses"](spark, tables(spark, tmp_path)).collect()
    found = {r["doc_id"]: (r["n_clauses"], r["clauses"]) for r in rows}
    assert found == {1: (3, "un plan\naudit des comptes\nthble revue annuelle"), 2: (1, "seul"), 3: (0, ""), 4: (1, "thblex reste the")}


def test_query_of_coverage(spark, tmp_path):
    rows = QUERIES["clause_coverage"](spark, tables(spark, tmp_path)).collect()
    found = {r["doc_id"]: (r["n_clauses"], r["n_covered"], r["sufficient"]) for r in rows}
    assert found == {1: (2, 1, True), 2: (0, 0, True), 3: (0, 0, True), 4: (1, 0, False)}
