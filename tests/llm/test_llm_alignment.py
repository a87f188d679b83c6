"""Token alignment against a plain walk over whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
import tokenizers

from seekgrain.llm import token_alignment as ta
from seekgrain.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
A, B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def models():
    return ta.load_models(A, B)


def brute_force(texts):
    """Per text (n_a, n_b, n_groups, n_links, n_best, count_sum, groups)."""
    first = tokenizers.Tokenizer.from_file(A)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=B)
    signs = ta.byte_signs()
    entries = {i: e for e, i in first.get_vocab().items()}

    def b_bytes(i):
        piece = second.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()

    found = []
    for text in texts:
        whole = (" " + (text or "")).encode()
        a = first.encode(whole.decode(), add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        x = [bytes(signs[s] for s in entries[i]) for i in a]
        y = [b_bytes(i) for i in b]
        if not text or b"".join(x) != whole or b"".join(y) != whole:
            found.append(None)
            continue
        spans = []
        for ids, parts in ((a, x), (b, y)):
            at, out = 0, []
            for i, p in zip(ids, parts):
                out.append((i, at, at + len(p)))
                at += len(p)
            spans.append(out)
        groups, links, j, k, begin = [], [], 0, 0, (0, 0)
        while j < len(spans[0]) and k < len(spans[1]):
            (ia, _, ea), (ib, _, eb) = spans[0][j], spans[1][k]
            links.append((ia, ib))
            j, k = j + (ea <= eb), k + (eb <= ea)
            if ea == eb:
                sides = (spans[0][begin[0] : j], spans[1][begin[1] : k])
                groups.append("|".join(",".join(str(s[0]) for s in side) for side in sides))
                begin = (j, k)
        found.append((len(a), len(b), groups, links))
    counts = Counter(p for f in found if f for p in f[3])
    top = Counter()
    for (_, b), c in counts.items():
        top[b] = max(top[b], c)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            best = sum(counts[p] == top[p[1]] for p in f[3])
            text = ";".join(f[2])
            out.append((f[0], f[1], len(f[2]), len(f[3]), best, sum(counts[p] for p in f[3]), hashlib.sha256(text.encode()).hexdigest()))
    return out, counts


def odd_texts():
    rng = random.Random(5)
    texts = [
        None, "", " ", "a", " a", "a ", "  two  spaces ", "tab\tand\nline\r\n", "sign ▁ here", "a▁b c", "▁", "<|endoftext|> x <s> </s> <unk> <0x41>",
        "naïve café – “quotes”", "日本語 の テキスト", "emoji 👩‍👩‍👧 ok", "nbsp x y z", "\x00 nul \x01", "﻿bom", "don't we'll I'm it's",
        "x" * 3000, "word " * 5000 + "end", "a  b" * 200, "1234567890 12 3 4567", "é combining", "\x1c a \x85 b", "... !!! ,,, a.b c",
    ]
    alphabet = "ab \n\t.,'é▁日👍0 <>s"
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    return texts + texts[20:40]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def check(spark, models, texts, parts=4):
    rows = [(i if i % 3 else None, i, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, n_a int, text string").repartition(parts)
    result = ta.align(frame, models, keep_groups=True)
    expected, counts = brute_force(texts)
    found = {r.payload.n_a: r for r in result.documents.collect()}
    assert len(found) == len(texts)
    for i, e in enumerate(expected):
        assert tuple(found[i][c] for c in COLUMNS) == e, texts[i]
        assert (hashlib.sha256(found[i].groups.encode()).hexdigest() if e[0] else "") == e[-1]
    assert {(r.a_id, r.b_id): r["count"] for r in result.pairs.collect()} == counts


def test_odd_texts(spark, models):
    check(spark, models, odd_texts())


def test_long_texts_are_several_blocks(spark, models):
    text = "some words of a text " * 400
    pieces = list(ta._cut(text, 500))
    assert len(pieces) > 10 and " ".join(pieces) == text
    whole, run = ta._Run(models.tokenizers(), [text]), ta._Run(models.tokenizers(), pieces)
    assert run.counts.sum(axis=0).tolist() == whole.counts[0].tolist()
    assert b"".join(run.groups(k) for k in range(len(pieces))) == whole.groups(0)


def test_a_megabyte(spark, models):
    rng = random.Random(1)
    long = " ".join(rng.choice(["alpha", "Beta,", "gamma.", "naïve", "x  y"]) for _ in range(900_000))
    assert len(long) > ta.RUN_CHARS
    check(spark, models, [long, long + " ▁", "short", None, long[:1_500_000], long[:1_200_000] + " a▁b " + long[:99]], parts=2)


def test_pointer_jumping_on_random_cuts():
    rng = np.random.default_rng(0)
    for size in (1, 2, 5, 50, 400):
        ends = [np.r_[np.sort(rng.choice(np.arange(1, size), rng.integers(0, size), replace=False)), size] if size > 1 else np.array([1]) for _ in range(2)]
        a, b = ta.links(*ends)
        starts = [np.r_[0, e[:-1]] for e in ends]
        plain = [(i, j) for i in range(len(ends[0])) for j in range(len(ends[1])) if starts[0][i] < ends[1][j] and starts[1][j] < ends[0][i]]
        assert list(zip(a.tolist(), b.tolist())) == plain
        last = ta.group_ends(*ends, a, b)
        both = np.intersect1d(*ends)
        goal = [int(both[np.searchsorted(both, e)]) for e in np.concatenate(ends)]
        assert ends[1][last].tolist() == goal


def test_query(spark):
    rows = {r.doc_id: r for r in QUERIES["op13_token_alignment"](spark, FOLDER).collect()}
    source = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    expected, _ = brute_force([r.text for r in source])
    assert len(rows) == len(source)
    assert all(tuple(rows[r.doc_id][c] for c in COLUMNS) == e for r, e in zip(source, expected))


def test_empty_table(spark, models):
    result = ta.align(spark.createDataFrame([], "doc_id long, text string"), models)
    assert result.documents.count() == 0 and result.pairs.count() == 0
