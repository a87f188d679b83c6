"""Exact duplicates, n-gram Jaccard join and repeated passages against brute force."""

import random
import re

import pytest

from seekgrain.llm import exact_dedup, jaccard_join, substring_dedup
from seekgrain.llm.common import components

WORDS = [f"w{i}" for i in range(400)]


def texts(seed, n, least=5, most=120):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randint(least, most))) for _ in range(n)]


def edited(rng, text, changes):
    words = text.split(" ")
    for _ in range(changes):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


# ---- exact duplicates ---------------------------------------------------------------------------
def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(normal(t), []).append(i)
    out = []
    for ids in groups.values():
        known = [i for i in ids if i is not None]
        keep, kept = min(known) if known else None, False
        for i in sorted(ids, key=lambda x: (x is None, x or 0)):
            out.append((i, keep, len(ids), i == keep and not kept))
            kept = kept or i == keep
    return sorted(out, key=repr)


ROWS = [
    (5, "a  b"), (3, "a b"), (9, "a\tb"), (7, "other"), (8, None), (2, ""), (11, " "), (1, "é ü" * 50), (4, "é ü" * 50),
    (3, "a b"), (None, "other"), (None, "alone"), (None, "alone"), (12, "A b"), (6, "x" * 700), (10, "x" * 700), (13, "x" * 699),
]


@pytest.mark.parametrize("moduli,chunk", [(exact_dedup.MODULI, 1 << 16), (exact_dedup.MODULI, 16), ((7, 5), 64)])
def test_exact_groups(spark, moduli, chunk):
    groups = exact_dedup.equal_texts(docs(spark, ROWS), moduli=moduli, chunk_bytes=chunk)
    got = [tuple(r) for r in exact_dedup.kept_rows(groups).select("doc_id", "keep_id", "group_size", "kept").collect()]
    assert sorted(got, key=repr) == brute_exact(ROWS)


def test_fingerprint_does_not_depend_on_chunks(spark):
    frame = docs(spark, ROWS)
    seen = set()
    for chunk in (16, 100, 1 << 16):
        rows = exact_dedup.fingerprints(frame, chunk_bytes=chunk).select("text_key", "fp_a", "fp_b", "n_bytes").collect()
        seen.add(tuple(sorted(map(tuple, rows))))
    assert len(seen) == 1


def test_drop_copies_keeps_columns(spark):
    frame = spark.createDataFrame(
        [(i, t, k, "z") for k, (i, t) in enumerate(ROWS)], "doc_id long, text string, text_key int, _key string"
    )
    got = exact_dedup.drop_copies(frame)
    assert got.columns == frame.columns
    expected = sorted(repr(r[0]) for r in brute_exact(ROWS) if r[3])
    assert sorted(repr(r["doc_id"]) for r in got.collect()) == expected
    assert exact_dedup.drop_copies(frame.limit(0)).collect() == []


# ---- components ---------------------------------------------------------------------------------
def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(50, 60), (60, 70), (70, 50), (100, 100)] + [(200, k) for k in range(201, 260)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 1 for i in range(2, 31)}, 60: 50, 70: 50, **{k: 200 for k in range(201, 260)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# ---- n-gram Jaccard join ------------------------------------------------------------------------
def brute_components(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = words_of(t)
        grams = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
        sets[i] = grams
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), root(i)) for i, s in sets.items())


def near_rows(seed, base=12, each=9):
    rng, rows = random.Random(seed), [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "one two")]
    shared = " ".join(rng.choice(WORDS) for _ in range(40))
    for text in texts(seed, base):
        for _ in range(each):
            rows.append((len(rows), edited(rng, text, rng.randint(0, 4)) + (" " + shared if rng.random() < 0.4 else "")))
    return rows


@pytest.mark.parametrize("frequent,block", [(500, 2048), (4, 2048), (6, 5)])
@pytest.mark.parametrize("width,percent", [(4, 85), (2, 60)])
def test_jaccard_join_is_exact(spark, monkeypatch, frequent, block, width, percent):
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", block)
    rows = near_rows(width)
    got = jaccard_join.similar_components(docs(spark, rows).repartition(3), width, percent).collect()
    assert sorted(map(tuple, got)) == brute_components(rows, width, percent)


def test_jaccard_join_odd_rows(spark):
    t = texts(1, 2, 60, 80)
    rows = [(5, t[0]), (5, t[0]), (None, t[0]), (None, t[1]), (None, t[1]), (None, None)]
    got = sorted(map(repr, map(tuple, jaccard_join.similar_components(docs(spark, rows), 4, 85).collect())))
    n0, n1 = len(words_of(t[0])) - 3, len(words_of(t[1])) - 3
    assert got == sorted(map(repr, [(5, n0, 5), (5, n0, 5), (None, n0, 5), (None, n1, None), (None, n1, None), (None, 0, None)]))
    assert jaccard_join.similar_components(docs(spark, []), 4, 85).collect() == []
    clash = docs(spark, rows[:2] + [(7, t[0]), (8, t[1])]).selectExpr("*", "1 AS node", "2 AS n")
    kept = jaccard_join.keep_first(clash)
    assert kept.columns == clash.columns and sorted(r.doc_id for r in kept.collect()) == [5, 5, 8]


def test_moved_prefixes_of_a_shared_id(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FREQUENT", 1)
    rows, t = [], texts(22, 24, 80, 80)
    for k in range(12):
        a, b = t[2 * k : 2 * k + 2]
        rows += [(10 * k + 3, a), (10 * k + 7, a), (10 * k + 7, b), (10 * k + 9, b + " end")]
    got = {r.doc_id: r.component_id for r in jaccard_join.similar_components(docs(spark, rows), 4, 85).collect()}
    assert got == {i: i // 10 * 10 + 3 for i, _ in rows}


def test_keep_first_decides_by_id_and_text(spark):
    a, b, c = texts(21, 3, 80, 80)
    rng = random.Random(2)
    near = [edited(rng, x, 1) for x in (a, b, b)]
    rows = [(5, a), (7, near[0]), (7, c), (None, near[0] + " end"), (None, b), (None, near[1]), (None, near[2]), (None, None)]
    kept = [tuple(r) for r in jaccard_join.keep_first(docs(spark, rows)).collect()]
    assert (5, a) in kept and (7, c) in kept and (None, None) in kept and len(kept) == 4
    assert [t in (b, *near[1:]) for i, t in kept if i is None and t] == [True]


def test_bounds_never_exclude_a_link():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(200):
        n, m = rng.integers(1, 3000, 2)
        x, y = (np.unique(rng.integers(0, int(1.2 * k) + 1, k).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for k in (n, m))
        sizes = np.array([len(x), len(y)])
        bits = jaccard_join.Bitmaps(jaccard_join.signatures(np.r_[x, y], np.r_[0, np.cumsum(sizes)]))
        if jaccard_join.linked(x, y, 60):
            assert jaccard_join.possible(sizes, bits, np.array([0]), np.array([1]), 60).all()
            assert len(set(x[: jaccard_join.prefix_sizes(sizes, 60)[0]]) & set(y[: jaccard_join.prefix_sizes(sizes, 60)[1]]))


# ---- repeated passages --------------------------------------------------------------------------
def test_repeated_passages(spark):
    rng = random.Random(4)
    passage, near = texts(5, 2, 70, 70)
    filler = texts(6, 12, 100, 160)
    rows = [(i, t) for i, t in enumerate(filler)]
    for i in (1, 4, 7):
        rows[i] = (i, f"{filler[i]} {passage} {filler[i + 1][:200]}")
    rows[9], rows[10] = (9, f"{filler[9]}\n{near}"), (10, f"{edited(rng, near, 1).upper()} {filler[10]}")
    short = " ".join(passage.split(" ")[:40])
    rows += [(20, f"{filler[0][:150]} {short}"), (21, None), (22, ""), (23, filler[3]), (None, filler[3]), (24, passage + " " + passage)]
    frame = docs(spark, rows).withColumnRenamed("doc_id", "doc_id").selectExpr("*", "3 AS node").repartition(4)
    got = {}
    for r in substring_dedup.repeated_passages(frame).collect():
        got.setdefault(r.doc_id, []).append((r.word_start, r.word_end))
        assert r.n_words == r.word_end - r.word_start >= 50

    def covered(i, text, part):
        start = len(words_of(text[: text.lower().index(part.lower())]))
        return any(a <= start and start + len(part.split(" ")) <= b for a, b in got.get(i, []))

    for i in (1, 4, 7):
        assert covered(i, rows[i][1], passage)
    assert got[24] == [(0, 140)] and covered(3, filler[3], filler[3]) and covered(23, filler[3], filler[3]) and None in got
    assert 9 in got and 10 in got
    assert set(got) == {1, 3, 4, 7, 9, 10, 23, 24, None}
    assert substring_dedup.repeated_passages(docs(spark, [])).collect() == []


@pytest.mark.parametrize("block", [2048, 16])
def test_passages_in_the_middle_of_a_group(spark, monkeypatch, block):
    """Copies that differ from the extreme ones meet the original, and each other, wherever these stand."""
    monkeypatch.setattr(substring_dedup, "BLOCK_ROWS", block)
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(50)]
    rows = {i: " ".join(passage[:k] + [f"x{i}"] + passage[k + 1 :]) for i in range(60) for k in [6 + 37 * i % 38]}
    rows[30] = " ".join(passage)
    # A line that many texts share, and two texts in their middle that share more.
    line = " ".join(f"q{i}" for i in range(30))
    for i in range(100, 160):
        rows[i] = " ".join([f"a{i}_{k}" for k in range(40)] + [line] + [f"b{i}_{k}" for k in range(40)])
    for i in (120, 140):
        rows[i] = f"alone{i} " + " ".join(rows[130].split(" ")[:80])
    del rows[130]
    got = {r.doc_id: r for r in substring_dedup.repeated_passages(docs(spark, list(rows.items()))).collect()}
    assert got[30].n_words == 50 and got[120].n_words >= 70 and got[140].with_doc_id == 120
    near = {i for i in range(60) if i != 30}
    assert len(near & set(got)) >= 0.9 * len(near), sorted(near - set(got))
    assert not [i for i in got if 100 <= i < 160 and i not in (120, 140)]


def test_compact_windows_cover_every_window():
    import numpy as np

    rng = np.random.default_rng(5)
    tokens = rng.integers(0, 30, 300).astype(np.uint64)
    owner = np.repeat([0, 1, 2], [100, 3, 197])
    from seekgrain.llm.shingles import mixed

    values = mixed(tokens ^ mixed(np.uint64(1)))
    least, of, first, centre, last = substring_dedup.compact_windows(tokens, owner, 12, 0)
    seen = {}
    for low, c, f, l in zip(least, centre, first, last):
        for s in range(f, l + 1):
            seen[s] = low
            assert values[s : s + 12].min() == low
        assert values[c] == low and f <= c < f + 12
    assert sorted(seen) == [s for s in range(289) if owner[s] == owner[s + 11]]


def test_repeated_passages_leave_no_files_of_done_steps(spark):
    """Shuffle files go with the step that made them, and tables that no later step reads are removed."""
    import glob
    import time
    from pathlib import Path

    from seekgrain.llm.common import SHUFFLE_CLEANUP, shared_folder

    def shuffles():
        """Ids of the shuffles that have files, from their names shuffle_<id>_<map>_0.data."""
        folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return {f.getName().split("_")[1] for d in folder.localDirs() for f in _files(d) if f.getName().endswith(".data")}

    def _files(folder):
        for f in folder.listFiles() or []:
            yield from _files(f) if f.isDirectory() else [f]

    tables = Path(shared_folder(spark).removeprefix("file:")) / "tables"
    before, known, was = shuffles(), set(glob.glob(f"{tables}/*")), spark.conf.get(SHUFFLE_CLEANUP, None)
    passage = texts(5, 1, 70, 70)[0]
    rows = [(i, f"{t} {passage}") for i, t in enumerate(texts(6, 12, 100, 160))]
    found = substring_dedup.repeated_passages(docs(spark, rows))
    until = time.time() + 20
    while len(shuffles() - before) > 3 and time.time() < until:  # executors remove files a little later
        time.sleep(0.2)
    assert len(shuffles() - before) <= 3  # counts of rows
    # What the result is read from: verified spans of both searches and what the second one found.
    assert len(set(glob.glob(f"{tables}/*")) - known) <= 4
    assert found.count() == 12
    assert spark.conf.get(SHUFFLE_CLEANUP, "false") == (was or "false")


@pytest.mark.parametrize("kinds", [12, 40, 1000])
def test_windows_with_repeats_are_compared_alike_as_matrix_and_as_runs(monkeypatch, kinds):
    import numpy as np

    rng = np.random.default_rng(kinds)
    for _ in range(40):
        x = rng.integers(0, kinds, 30 + int(rng.integers(0, 60))).astype(np.uint32)
        y = np.where(rng.random(len(x)) < 0.08, rng.integers(0, kinds, len(x)), x).astype(np.uint32)
        brute = [
            100 * len(a & b) >= 80 * len(a | b)
            for a, b in ((set(x[s : s + 30].tolist()), set(y[s : s + 30].tolist())) for s in range(len(x) - 29))
        ]
        assert substring_dedup.alike_windows(x, y, 30, 80).tolist() == brute
        with monkeypatch.context() as patch:
            patch.setattr(substring_dedup, "DENSE", 0)
            assert substring_dedup.alike_windows(x, y, 30, 80).tolist() == brute


@pytest.mark.parametrize("crowded", [0, 1 << 30])
def test_crowded_blocks_find_the_same(spark, monkeypatch, crowded):
    monkeypatch.setattr(substring_dedup, "CROWDED", crowded)
    test_passages_in_the_middle_of_a_group(spark, monkeypatch, 16)
