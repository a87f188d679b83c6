"""Language identification by error-correcting output codes.

Every language gets a codeword of bits. One binary classifier per bit, logistic regression over hashed
n-grams of UTF-8 bytes, says how sure it is of its bit. Decoding adds up, per language, the loss of
all bits against its codeword, each weighted by how well its classifier did in training; the language
with the least loss is nearest. Two languages at nearly the same loss make the answer ambiguous.
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekgrain.llm.common import giving_back, remainder_of_id, unused
from seekgrain.llm.quality import runs, text_buffers
from seekgrain.llm.training import bounded_classes

#: Labelled rows the classifiers are fitted on, at most; with many languages so many of each.
TRAINING_ROWS, LANGUAGE_ROWS = 4_000, 50
BUCKETS = 1 << 11
ORDERS = (1, 2, 3)
STEPS, STEP_SIZE, RIDGE = 150, 8.0, 1e-4
#: Up to this many languages every split of them is a bit; with more, about 10 log2 n seeded ones are.
EXHAUSTIVE = 6
#: The best language must be this much more likely than the second, or the answer is flagged.
CLEAR_RATIO = 4.0
#: Texts counted at once, in bytes and in rows.
RUN_BYTES, RUN_ROWS = 1 << 20, 1024
UNKNOWN = "und"


def codewords(n: int, seed: int = 0) -> np.ndarray:
    """n rows of +1 and -1; columns are the bits. Random codes keep the largest least distance of some tries."""
    if n <= EXHAUSTIVE:
        columns = [(1, *rest) for rest in itertools.product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(columns, dtype=np.float64).reshape(-1, n).T
    rng, best, best_distance = random.Random(seed), None, -1
    width = math.ceil(10 * math.log2(n))
    for _ in range(64):
        code = []
        for _ in range(width):
            column = [1] * (n // 2) + [-1] * (n - n // 2)
            rng.shuffle(column)
            code.append(column)
        rows = np.array(code, dtype=np.float64).T
        distance = min(int((rows[a] != rows[b]).sum()) for a, b in itertools.combinations(range(n), 2))
        if distance > best_distance:
            best, best_distance = rows, distance
    return best


def ngram_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Square roots of hashed n-gram counts, one row of unit length per text."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.zeros(n * BUCKETS)
    signs = data.astype(np.uint32)
    for order in ORDERS:
        size = max(0, len(data) - order + 1)
        gram = np.full(size, order, dtype=np.uint32)
        for k in range(order):
            gram = gram * np.uint32(257) + signs[k : k + size]
        bucket = ((gram * np.uint32(2654435761)) >> np.uint32(32 - 11)).astype(np.int64)
        whole = owner[:size] == owner[order - 1 :][:size]
        counts += np.bincount(owner[:size][whole] * BUCKETS + bucket[whole], minlength=n * BUCKETS)
    x = np.sqrt(counts.reshape(n, BUCKETS)).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


@dataclass
class Languages:
    names: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def likelihoods(self, x: np.ndarray) -> np.ndarray:
        """Per row and language, from the weighted loss of all bits against the codeword."""
        margins = x @ self.weights + self.bias
        loss = np.logaddexp(0, -margins[:, None, :] * self.codes[None, :, :]) @ self.trust
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        return p / p.sum(axis=1, keepdims=True)


def fit_languages(x: np.ndarray, labels: list[str]) -> Languages:
    """Weighted so that every language counts alike; the first language of the sorted names wins ties."""
    names = sorted(set(labels))
    codes = codewords(len(names)) if len(names) > 1 else np.ones((len(names), 1))
    index = np.array([names.index(v) for v in labels], dtype=int)
    wanted = codes[index] if names else np.zeros((0, 1))
    share = np.bincount(index, minlength=len(names)) if names else np.zeros(0)
    weight = (1 / (share[index] * len(names)))[:, None] if names else np.zeros((0, 1))
    w, b = np.zeros((BUCKETS, wanted.shape[1])), np.zeros(wanted.shape[1])
    x = x.astype(np.float64)
    fast_w, fast_b = w.copy(), b.copy()
    for step in range(STEPS if len(names) > 1 else 0):
        pull = -wanted * weight / (1 + np.exp(wanted * (x @ fast_w + fast_b)))
        next_w = fast_w - STEP_SIZE * (x.T @ pull + RIDGE * fast_w)
        next_b = fast_b - STEP_SIZE * 0.1 * pull.sum(axis=0)
        momentum = step / (step + 3)
        fast_w, fast_b = next_w + momentum * (next_w - w), next_b + momentum * (next_b - b)
        w, b = next_w, next_b
    wrong = (((x @ w + b) * wanted <= 0) * weight).sum(axis=0) if len(names) > 1 else np.full(wanted.shape[1], 0.5)
    wrong = np.clip(wrong, 0.01, 0.49)
    trust = np.log((1 - wrong) / wrong)
    return Languages(names, codes, w.astype(np.float32), b.astype(np.float32), trust / max(trust.mean(), 1e-9))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in runs(batch, "text", RUN_BYTES, RUN_ROWS):
            x = ngram_features(*text_buffers(part.column("text")))
            values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), BUCKETS).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([part.column("lang"), values], names=["lang", "x"])


def fit(docs: DataFrame, bound: int = TRAINING_ROWS, least: int = LANGUAGE_ROWS) -> Languages:
    """Classifiers for every non-null ``lang`` of ``docs``.

    Each language is learned from max(``least``, ``bound`` / languages) rows at most, chosen by a hash of the
    id, so a rare language has its codeword at every size of the table. Held-out ids, null ids and texts
    without a letter are not learned from.
    """
    usable = docs.filter((remainder_of_id() != 2) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sample = bounded_classes(usable.select("doc_id", "lang", "text"), "lang", ["doc_id"], bound, least)
    sample = sample.select("lang", F.lower("text").alias("text"))
    rows = sample.mapInArrow(giving_back(_features), "lang string, x array<float>").toArrow()
    if not rows.num_rows:
        return fit_languages(np.zeros((0, BUCKETS)), [])
    x = np.asarray(rows.column("x").combine_chunks().flatten()).reshape(-1, BUCKETS)
    labels = rows.column("lang").to_pylist()
    order = np.lexsort([x @ np.arange(1, BUCKETS + 1), labels])
    return fit_languages(x[order], [labels[i] for i in order])


def with_language(docs: DataFrame, model: Languages, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1), second and ambiguous.

    Null texts and texts without a letter are ``und`` with score 0, and so is everything when no
    language was learned. Rows are judged one by one, so repeats get the same answer and an empty table
    stays empty. Columns named like the results are replaced.
    """
    docs = docs.drop("lang_pred", "score", "second", "ambiguous")
    low = unused(docs, "_low")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part in runs(batch, low, RUN_BYTES, RUN_ROWS):
                told = np.asarray(part.column(low).is_valid()) & bool(known.names)
                p = known.likelihoods(ngram_features(*text_buffers(part.column(low)))) if known.names else np.zeros((len(told), 1))
                best = p.argmax(axis=1)
                at = np.arange(len(p))
                rest = p.copy()
                rest[at, best] = -1
                next_best = rest.argmax(axis=1)
                top, second = p[at, best], np.maximum(rest[at, next_best], 0)
                names = np.array([*known.names, UNKNOWN], dtype=object)
                kept = [n for n in part.schema.names if n != low]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(n) for n in kept],
                        pa.array(np.where(told, names[best], UNKNOWN), pa.string()),
                        pa.array(np.where(told, np.clip(top, 0, 1), 0.0), pa.float64()),
                        pa.array(np.where(told & (len(known.names) > 1), names[next_best], None), pa.string()),
                        pa.array(~told | (top < CLEAR_RATIO * second), pa.bool_()),
                    ],
                    names=[*kept, "lang_pred", "score", "second", "ambiguous"],
                )

    lettered = F.when(F.col(text).rlike(r"\p{L}"), F.lower(text))
    added = {"lang_pred": T.StringType(), "score": T.DoubleType(), "second": T.StringType(), "ambiguous": T.BooleanType()}
    schema = T.StructType([*docs.schema.fields, *[T.StructField(name, kind) for name, kind in added.items()]])
    return docs.withColumn(low, lettered).mapInArrow(giving_back(run), schema)
