"""Embedding whitening against plain linear algebra."""

import math
from fractions import Fraction

import numpy as np
import pytest

from seekgrain.llm import whitening
from seekgrain.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("size", [1, 2, 3, 17, 64])
@pytest.mark.parametrize("kind", ["full", "low", "equal", "blocks", "close"])
def test_leading_components(size, kind):
    rng = np.random.default_rng(size)
    a = rng.standard_normal((size, 2 * size))
    matrix = a @ a.T
    if kind == "low":
        matrix = a[:, : max(1, size // 3)] @ a[:, : max(1, size // 3)].T
    elif kind == "equal":
        matrix = np.eye(size)
    elif kind == "blocks":
        matrix = np.diag(np.repeat([3.0, 2.0, 1.0], size)[:size])
    elif kind == "close":
        turn = np.linalg.qr(a[:, :size])[0]
        matrix = turn @ np.diag(1 + 1e-9 * np.arange(size)) @ turn.T
    values, vectors = whitening.leading_components(matrix, 16)
    plain = np.sort(np.linalg.eigvalsh(matrix))[::-1]
    trace = np.trace(matrix)
    assert len(values) == min(16, (plain > 1e-11 * trace).sum())
    assert np.abs(values - plain[: len(values)]).max() < 1e-13 * trace
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
    assert np.abs(matrix @ vectors - vectors * values).max() < 1e-13 * trace


def test_sturm_counts():
    rng = np.random.default_rng(0)
    diagonal, off = rng.standard_normal(12), rng.standard_normal(11)
    off[4] = 0
    values = np.linalg.eigvalsh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))
    at = np.linspace(-5, 5, 41)
    assert whitening.counts_below(diagonal, off, at).tolist() == [(values < a).sum() for a in at]


def brute_force(vectors):
    """(grid vectors by row, n, S, covariance) with exact sums."""
    grid = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    distinct = sorted({tuple(g) for g in grid})
    n = len(distinct)
    sums = [sum(c) for c in zip(*distinct)]
    centred = [[Fraction(n * x - s, n) for x, s in zip(g, sums)] for g in distinct]
    size = len(sums)
    spread = [[float(sum(r[i] * r[j] for r in centred) / n) for j in range(size)] for i in range(size)]
    return grid, n, sums, np.array(spread)


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 5)) * [3, 1, 0.5, 0.2, 0.05]
    good = [*base.tolist(), *base[:20].tolist(), base[0].tolist()]
    bad = [None, [], [1.0, None, 0.0, 0.0, 0.0], [float("nan")] * 5, [float("inf")] * 5, [1.0, 2.0]]
    rows = [(i % 7 if i % 5 else None, v, float(i)) for i, v in enumerate(good + bad)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened double").repartition(5)
    model = whitening.fit(frame, components=16)
    grid, n, sums, spread = brute_force(good)
    assert model.centre.n == n and model.centre.sums == sums
    values = np.sort(np.linalg.eigvalsh(spread))[::-1]
    assert np.allclose(model.eigenvalues, values, rtol=1e-12, atol=1e-13 * values[0])
    assert np.allclose(model.explained, values / values.sum(), rtol=1e-9)
    assert model.identity_error < 1e-9
    out = whitening.whiten(frame.withColumnRenamed("whitened", "number"), model).collect()
    assert len(out) == len(good)
    for r in out:
        x = grid[int(r.number)]
        assert int(r.deviation) == sum((n * a - s) ** 2 for a, s in zip(x, sums))
        centred = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums)])
        assert np.allclose(r.whitened, centred @ model.projection, atol=1e-12)
    assert {len(r.whitened) for r in out} == {5}


@pytest.mark.parametrize("vectors", [[], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 3])
def test_nothing_to_whiten(spark, vectors):
    frame = spark.createDataFrame([(1, v) for v in vectors], "vec_id long, embedding array<double>")
    model = whitening.fit(frame)
    rows = whitening.whiten(frame, model).collect()
    assert len(rows) == sum(v is not None for v in vectors)
    assert all(r.whitened == [] and r.deviation == 0 for r in rows)


def test_huge_entries(spark):
    frame = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 0.5]), (3, [3.0, 0.25])], "vec_id long, embedding array<double>")
    model = whitening.fit(frame)
    assert model.centre.n == 3 and model.identity_error < 1e-6
    assert all(np.isfinite(r.whitened).all() for r in whitening.whiten(frame, model).collect())


def test_query(spark):
    rows = QUERIES["op11_embedding_whitening"](spark, FOLDER).toPandas()
    source = spark.read.parquet(f"{FOLDER}/embeddings.parquet").toPandas()
    grid, n, sums, spread = brute_force([list(map(float, v)) for v in source["embedding"]])
    values, vectors = np.linalg.eigh(spread)
    values, vectors = values[::-1][:16], vectors[:, ::-1][:, :16]
    centred = (n * np.array(grid) - np.array(sums)) / n
    plain = centred @ vectors / np.sqrt(values)
    assert len(rows) == 16 * len(source) and set(rows["n"]) == {n}
    wide = rows.pivot(index="vec_id", columns="component", values="whitened").loc[source["vec_id"]].to_numpy()
    signs = np.sign((wide * plain).sum(axis=0))
    assert np.abs(wide - plain * signs).max() < 1e-8
    assert (rows["identity_error"] < 1e-4).all()
    shares = rows.groupby("component")["explained"].first().to_numpy()
    assert np.allclose(shares, values / np.trace(spread), rtol=1e-9)
    deviation = {v: sum((n * a - s) ** 2 for a, s in zip(g, sums)) for v, g in zip(source["vec_id"], grid)}
    assert all(deviation[v] == d for v, d in zip(rows["vec_id"], rows["deviation"]))
