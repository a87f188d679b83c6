"""The pipeline stage by stage, and the entry module without this package."""

import importlib
import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline
from seekgrain.llm import piece_scan

FOLDER = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (None, "", "en", "src0", 0), (5000, None, None, None, 1)], docs.schema
    )
    again = docs.limit(2)
    docs = docs.unionByName(odd).unionByName(again)
    out = [docs.cache()]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], FOLDER).cache())
    return dict(zip(["documents", *[n for n, _ in corpus_pipeline.STAGES]], out))


def test_columns(steps):
    for name in ("quality", "exact_dedup", "near_dedup", "mixing"):
        assert steps[name].columns == steps["documents"].columns


def test_quality_keeps_good_documents(spark, steps):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {r.doc_id for r in steps["quality"].collect()}
    good = [i for i, q in labels.items() if q == 1]
    bad = [i for i, q in labels.items() if q == 0]
    assert sum(i in kept for i in good) >= 0.97 * len(good) and sum(i not in kept for i in bad) >= 0.5 * len(bad)


def test_exact_stage(steps):
    groups = {}
    for r in steps["quality"].collect():
        groups.setdefault(normal(r.text), []).append(r.doc_id)
    expected = Counter(min((i for i in ids if i is not None), default=None) for ids in groups.values())
    assert Counter(r.doc_id for r in steps["exact_dedup"].collect()) == expected


def test_near_stage(steps):
    rows = {r.doc_id: grams(r.text) for r in steps["exact_dedup"].collect()}
    ids = sorted(i for i in rows if i is not None)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            common = len(rows[a] & rows[b])
            if a < b and common and 5 * common >= 4 * len(rows[a] | rows[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    assert {r.doc_id for r in steps["near_dedup"].collect()} - {None} == {i for i in ids if root(i) == i}


def test_mixing_and_encoding_stages(steps):
    before = Counter(r.doc_id for r in steps["near_dedup"].collect())
    after = Counter(r.doc_id for r in steps["mixing"].collect())
    assert set(after) <= set(before) and all(after[i] <= 2 * before[i] for i in after)
    pieces = piece_scan.load_pieces("/opt/tokenizers/piece_bpe_32k.model")
    text = {r.doc_id: r.text for r in steps["mixing"].collect()}
    back = piece_scan.decode(steps["encoding"], pieces, "ids", "again").collect()
    assert len(back) == sum(after.values()) and all(r.again == text[r.doc_id] for r in back)


def test_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        assert docs.collect() == []


def test_entry_without_the_package():
    """The entry module imports, and the rest stays registered, where these files are gone."""
    code = (
        "import sys; sys.modules['seekgrain.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e; names = e.queries(); assert 'rrf_hybrid' in names\n"
        "assert not any(n.startswith('op') or n == 'pipeline' for n in names), names\n"
        "assert not any(n.startswith('op') for n in e.oracle_sql())\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
    names = importlib.import_module("__spark_entry__").queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if re.match(r"op\d+_", n)) == list(range(1, 14)) and "pipeline" in names
