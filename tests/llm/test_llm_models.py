"""Quality trees, language codes and piece encoding."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from seekgrain.llm import language_id, piece_scan, quality
from seekgrain.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def pieces():
    return piece_scan.load_pieces(MODEL)


# ---- quality ------------------------------------------------------------------------------------
def test_quality_on_held_out_rows(spark):
    scored = QUERIES["op4_quality"](spark, FOLDER)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = scored.join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 50 and sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    assert scored.count() == 1000 and scored.filter("score < 0 or score > 1").isEmpty()


def test_flat_trees_equal_a_plain_walk():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, quality.FEATURES))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    trees = quality.fit_trees(x, y)

    def walk(row):
        total = trees.base
        for node in trees.roots:
            while trees.child[node] >= 0:
                node = trees.child[node] + (row[trees.feature[node]] > trees.threshold[node])
            total += trees.value[node]
        return 1 / (1 + np.exp(-total))

    scores = trees.scores(x)
    assert np.allclose(scores, [walk(r) for r in x]) and ((scores > 0.5) == (y == 1)).mean() > 0.95


def test_statistics_do_not_depend_on_neighbours():
    texts = ["a b a b a b\nline one\nline one", "", None, "ÉÜ x", "one", " \n\t ", "ab" * 400, "A!! B!! C!!"]
    together = quality.statistics(*quality.text_buffers(pa.array(texts)))
    alone = np.concatenate([quality.statistics(*quality.text_buffers(pa.array([t], pa.string()))) for t in texts])
    sliced = quality.statistics(*quality.text_buffers(pa.array(["zz"] + texts).slice(1)))
    assert np.allclose(together, alone) and np.allclose(together, sliced)


def test_quality_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (None, "", 0.1), (1, "x y", 0.2)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    trees = quality.fit(docs, none)
    got = quality.with_score(docs, trees).collect()
    assert len(got) == 3 and {r.score for r in got} == {0.5}
    odd = spark.createDataFrame([(None, 1), (1, None), (1, 7)], "doc_id long, quality int")
    assert quality.fit(docs, odd).scores(np.zeros((1, quality.FEATURES)))[0] == 0.5
    assert quality.keep_good(docs.limit(0), trees).collect() == []
    assert quality.keep_good(docs, trees, 0.5).columns == docs.columns


# ---- language -----------------------------------------------------------------------------------
def test_languages_on_held_out_rows(spark):
    told = QUERIES["op2_language_id"](spark, FOLDER)
    rows = told.join(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = rows.filter("held_out").collect()
    assert len(rows) > 150 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)


def test_codewords():
    for n in (2, 3, 4, 6, 9, 20):
        code = language_id.codewords(n)
        assert code.shape[0] == n and set(np.unique(code)) == {-1.0, 1.0}
        least = min((code[a] != code[b]).sum() for a, b in itertools.combinations(range(n), 2))
        assert least >= (1 if n == 2 else code.shape[1] // 4)


def test_language_odd_rows(spark):
    learn = [(i, "en" if i % 2 else "de", ("the house and the mouse " if i % 2 else "das Haus und die Maus ") * 3) for i in range(60)]
    learn += [(70, None, "quoi"), (71, "fr", None), (72, "fr", "123")]
    model = language_id.fit(spark.createDataFrame(learn, "doc_id long, lang string, text string"))
    assert model.names == ["de", "en"]
    rows = [(1, None, "x"), (2, "", "x"), (3, "12 ?!", "x"), (4, "THE mouse and the house", "x"), (None, "die Maus und das Haus", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    got = [(r.lang_pred, r.score) for r in language_id.with_language(docs, model).orderBy("text").collect()]
    assert [g[0] for g in got] == ["und", "und", "und", "en", "de"]
    assert [g[1] for g in got][:3] == [0, 0, 0] and all(0.5 < g[1] <= 1 for g in got[3:])
    empty = language_id.fit(docs.select("doc_id", "text", "lang_pred").withColumnRenamed("lang_pred", "lang").limit(0))
    assert {r.lang_pred for r in language_id.with_language(docs, empty).collect()} == {"und"}
    assert language_id.with_language(docs.limit(0), model).collect() == []


# ---- pieces -------------------------------------------------------------------------------------
TEXTS = ["", "a", " lead", "two  spaces ", "line\nnext\r\n\ttab", "▁ sign", "über Ñandú 日本 \U0001f600", "x" * 900, "thea nd " * 90, "<s> </s> <0x41>"]


def plain_cost(pieces, text):
    """Least cost of a text by the textbook recurrence."""
    import bisect

    keys = pieces.prefixes.tolist()
    best = [0] + [10**18] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - pieces.longest), end):
            h = piece_scan._hash_of(text[start:end])
            k = bisect.bisect_left(keys, h)
            if k < len(keys) and keys[k] == h and pieces.ids[k] >= 0:
                best[end] = min(best[end], best[start] + int(pieces.costs[k]))
        if not any(piece_scan._hash_of(text[end - 1]) == k for k in (keys[bisect.bisect_left(keys, piece_scan._hash_of(text[end - 1]))],)):
            best[end] = min(best[end], best[end - 1] + pieces.unknown_cost)
    return best[-1]


def test_best_paths_against_recurrence(pieces):
    rng = random.Random(7)
    for _ in range(12):
        text = "".join(rng.choice("theand \né▁日") for _ in range(rng.randint(1, 40)))
        signs, offsets = piece_scan._signs([text])
        assert piece_scan.best_paths(pieces, signs, offsets)[0][-1] == plain_cost(pieces, text)


def test_matrices_combine_to_the_whole(pieces):
    rng = random.Random(8)
    for alphabet in ("thea nd\n▁é", "abx", "the "):
        text = "".join(rng.choice(alphabet) for _ in range(700))
        signs, offsets = piece_scan._signs([text])
        whole = piece_scan.best_paths(pieces, signs, offsets)[0][-1]
        for size in (16, 50, 333):
            starts = range(0, len(text), size)
            parts = [piece_scan.chunk_matrix(pieces, text[s : s + size + pieces.longest - 1], min(size, len(text) - s)) for s in starts]
            left = right = None
            for p in parts:
                left = p if left is None else piece_scan.combine(left, p)
            for p in parts[::-1]:
                right = p if right is None else piece_scan.combine(p, right)
            assert left[0, 0] == right[0, 0] == whole


def test_round_trip_and_chunks(spark, pieces):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, None, 2), (1, "a", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    whole = {r.doc_id: r.ids for r in piece_scan.encode(docs, pieces).collect()}
    assert whole[None] is None and whole[0] == []
    cut = piece_scan.encode(docs, pieces, chunk_chars=64)
    assert len(cut.collect()) == len(rows)
    for chunk in (1 << 16, 64):
        checked = piece_scan.encode(docs, pieces, chunk_chars=chunk, check="same").collect()
        assert all(r.same for r in checked) and len(checked) == len(rows)
    for frame in (piece_scan.encode(docs, pieces), cut):
        back = piece_scan.decode(frame, pieces, "ids", "again").collect()
        assert all(r.again == r.text for r in back) and len(back) == len(rows)
    assert piece_scan.encode(docs.limit(0), pieces).collect() == []


def test_matrices_are_combined_in_rounds(spark, pieces, monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcde fgh é日") for _ in range(n)) for n in (5, 300, 2_000, 9_000)] + ["x" * 3_000, None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(piece_scan, "FAN", 4)
    cost = {int(i): int(c) for i, c in zip(pieces.ids, pieces.costs) if i >= 0}

    def total(ids):
        return sum(cost.get(i, 0) for i in ids) + pieces.unknown_cost * sum(i not in cost for i in ids)

    whole = {r.doc_id: r.ids for r in piece_scan.encode(docs, pieces).collect()}
    for r in piece_scan.encode(docs, pieces, chunk_chars=50, check="same").collect():
        assert r.same is not False and (r.ids is None) == (whole[r.doc_id] is None)
        assert r.ids is None or total(r.ids) == total(whole[r.doc_id])


def test_a_giant_text_is_cut_in_linear_time(spark, pieces):
    rng = random.Random(8)
    text = " ".join(rng.choice(["word", "other", "naïve", "日本"]) for _ in range(1_500_000))
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    rows = piece_scan.encode(docs, pieces, check="same").select("doc_id", "same", "ids").collect()
    assert all(r.same for r in rows) and min(len(r.ids) for r in rows) < 10 < max(len(r.ids) for r in rows)


def test_rare_languages_are_learned_at_every_size(spark):
    from seekgrain.llm.training import bounded_classes

    rows = [(i, "de" if i else "xx", f"text {i}") for i in range(3_000)] + [(None, "fr", "a"), (7, "fr", "b")]
    frame = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(4)
    found = bounded_classes(frame, "lang", ["doc_id"], 60, 5)
    counts = {r.lang: r["count"] for r in found.groupBy("lang").count().collect()}
    assert counts == {"de": 20, "xx": 1, "fr": 2}
    assert sorted(map(repr, found.collect())) == sorted(map(repr, bounded_classes(frame.repartition(2), "lang", ["doc_id"], 60, 5).collect()))
    model = language_id.fit(frame)
    assert {"de", "xx"} <= set(model.names)


def test_decoding_against_a_plain_sum():
    rng = np.random.default_rng(9)
    for n in (2, 3, 5, 9):
        codes = language_id.codewords(n)
        bits = codes.shape[1]
        model = language_id.Languages(
            [f"l{i}" for i in range(n)], codes, rng.normal(size=(language_id.BUCKETS, bits)), rng.normal(size=bits), rng.uniform(0.5, 2, bits)
        )
        x = language_id.ngram_features(*quality.text_buffers(pa.array(["some text", "etwas", "ein", "é"])))
        for row, p in zip(x, model.likelihoods(x)):
            margins = [sum(float(a) * float(w) for a, w in zip(row, model.weights[:, k])) + model.bias[k] for k in range(bits)]
            loss = [sum(model.trust[k] * np.log1p(np.exp(-margins[k] * codes[i, k])) for k in range(bits)) for i in range(n)]
            plain = np.exp(-np.array(loss))
            assert np.allclose(p, plain / plain.sum(), atol=1e-9) and p.argmax() == int(np.argmin(loss))


def test_library_agrees(pieces):
    import math

    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(open(MODEL, "rb").read())
    whole = math.log(len(model.pieces))
    for piece in model.pieces:
        if piece.type == 1:
            piece.score = -round(piece_scan.UNIT * (math.log(1 - piece.score) + math.log(whole))) / piece_scan.UNIT
    model.trainer_spec.model_type = 1  # the same pieces, read as a unigram model
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    texts = ["Is and retitioning ouen the of, nterti thorreou ndernt.", "Vièle aile mentoiier éanment.", "two  words"]
    ids, offsets = piece_scan.encode_texts(pieces, [" " + t for t in texts])
    for k, text in enumerate(texts):
        own = ids[offsets[k] : offsets[k + 1]].tolist()
        assert own == library.encode(text) and library.decode(own) == text
