"""Containment join, query-set checks, digests and changed cells."""

import random

import pytest
from pyspark.sql import functions as F

from seekgrain.operators import containment, query_sets
from suite import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["contained_texts", "query_set_checks", "table_digest", "changed_cells"])
def test_oracle(spark, name):
    import duckdb

    base = duckdb.connect()
    for table in ("documents", "benchmark", "labels", "customer", "nation"):
        base.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    frame = QUERIES[name](spark, FOLDER)
    names = sorted(frame.columns)
    expected = base.execute(f"select {', '.join(names)} from ({ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, frame.select(*names).collect()))) == sorted(map(repr, expected))
    assert expected


def test_every_check_fails_somewhere(spark):
    issues = {r.check_name: r.n_issues for r in QUERIES["query_set_checks"](spark, FOLDER).collect()}
    assert len(issues) == 11 and all(issues.values()), issues


@pytest.mark.parametrize("bounded", [20_000, 0])
def test_containment_against_all_pairs(spark, monkeypatch, bounded):
    monkeypatch.setattr(containment, "BOUNDED_ROWS", bounded)
    rng = random.Random(3)
    words = ["ab", "abc", "b", "bc", "x" * 30, "é", "a\nb", ""]
    held = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(60)] + [None, "", "ab", "y" * 50 + "x" * 30]
    asked = [h[rng.randint(0, 5) : rng.randint(6, 60)] for h in held if h] + ["x" * 25, "x" * 31, "ab", None, "", "zz zz zz", "x" * 12 + " " + "x" * 12]
    asked += [" ab abc ", "b " * 9]
    needles = spark.createDataFrame(list(enumerate(asked)), "n int, t string").repartition(3)
    texts = spark.createDataFrame(list(enumerate(held)), "d int, t string").repartition(4)
    found = {tuple(r) for r in containment.contained_texts(needles, "n", "t", texts, "d", "t", least_chars=5).collect()}
    plain = {
        (n, d, "equal" if a == h else "contains")
        for n, a in enumerate(asked) if a
        for d, h in enumerate(held) if h and (a == h or (len(a) >= 5 and a in h))
    }
    assert found == plain and len(plain) > 50


def test_digest_is_free_of_order(spark):
    rows = [(1, "a", None), (2, None, 0.5), (1, "a", None), (3, "é\"\n", 1.0)]
    frame = spark.createDataFrame(rows, "b int, a string, c double")
    one = query_sets.table_digest(frame).first()
    assert one == query_sets.table_digest(frame.repartition(3).select("c", "a", "b")).first() and one.n_rows == 4
    others = [frame.dropDuplicates(), frame.withColumn("c", F.lit(None).cast("double")), frame.union(frame), frame.limit(0)]
    assert len({one.digest, *[query_sets.table_digest(f).first().digest for f in others]}) == 5


def test_changed_cells_of_odd_tables(spark):
    before = spark.createDataFrame([(1, "x", 1.0), (2, None, None), (3, "=1", 5.0), (4, "gone", 0.0)], "k int, s string, v double")
    after = spark.createDataFrame([(1, "x", 1.0000001), (2, None, 2.0), (3, "'=1", 5.1), (5, None, 0.0)], "k int, s string, v double")
    found = {(r.k, r.column_name, r.change) for r in query_sets.changed_cells(before, after, "k", ["s", "v"], 1e-6).collect()}
    assert found == {
        (2, "v", "changed"), (3, "v", "changed"), (4, "s", "removed"), (4, "v", "removed"), (5, "s", "added"), (5, "v", "added"),
    }
    assert query_sets.changed_cells(before.limit(0), after.limit(0), "k", ["s"]).count() == 0
