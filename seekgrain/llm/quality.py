"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are counted with numpy inside tasks. The trees are fitted on a bounded
sample of labelled rows: features are binned at quantiles, a level of a tree sums gradients and
Hessians per (node, feature, bin), and every node takes the best split. Fitted trees are flattened
into arrays (feature, threshold, child, value), which a batch of rows walks level by level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekgrain.llm.common import giving_back, remainder_of_id, unused
from seekgrain.llm.training import bounded_sample

#: Labelled rows the trees are fitted on, at most.
TRAINING_ROWS = 12_000
THRESHOLD = 0.7
TREES, DEPTH, BINS, RATE, RIDGE, LEAST_ROWS = 60, 4, 64, 0.15, 1.0, 10
#: Texts are measured in runs of about this many bytes, and so many rows at most.
RUN_BYTES, RUN_ROWS = 1 << 20, 4096

_CLASSES = (
    "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\t\r\x0b\x0c", "\n", ".", ",", "!?",
    ";:'\"()-", "#*$%&", "|<>{}[]\\/=_^~`+@",
)


def _class_table() -> np.ndarray:
    table = np.full(256, len(_CLASSES) + 1, dtype=np.uint8)
    table[:128] = len(_CLASSES)
    for k, signs in enumerate(_CLASSES):
        table[[ord(s) for s in signs]] = k
    return table


CLASS_OF = _class_table()
N_CLASSES = len(_CLASSES) + 2
UPPER, SIGNS = 1, 6
BLANK = (3, 4, 5)
FEATURES = N_CLASSES + 15


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES numbers per text; ``data`` holds the UTF-8 bytes, text i from offsets[i] to offsets[i + 1]."""
    n = len(offsets) - 1
    out = np.zeros((n, FEATURES))
    lengths = np.diff(offsets).astype(np.float64)
    kinds = CLASS_OF[data]
    owner = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.bincount(owner * N_CLASSES + kinds, minlength=n * N_CLASSES).reshape(n, N_CLASSES).astype(np.float64)
    out[:, :N_CLASSES] = counts / np.maximum(lengths, 1)[:, None]
    if not len(data):
        return out
    filled = lengths > 0
    opens, closes = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
    opens[offsets[:-1][filled]] = True
    closes[offsets[1:][filled] - 1] = True
    blank = (kinds >= BLANK[0]) & (kinds <= BLANK[-1])
    starts = np.flatnonzero(~blank & (opens | np.r_[True, blank[:-1]]))
    stops = np.flatnonzero(~blank & (closes | np.r_[blank[1:], True])) + 1
    of_word = owner[starts]
    n_words = np.bincount(of_word, minlength=n).astype(np.float64)
    width = (stops - starts).astype(np.float64)

    def mean(values: np.ndarray) -> np.ndarray:
        return np.bincount(of_word, weights=values, minlength=n) / np.maximum(n_words, 1)

    k = N_CLASSES
    upper = kinds == UPPER
    out[:, k] = np.log1p(n_words)
    out[:, k + 1] = np.log1p(lengths)
    out[:, k + 2] = mean(width)
    out[:, k + 3] = np.sqrt(np.maximum(mean(width**2) - mean(width) ** 2, 0))
    out[:, k + 4] = mean(width <= 3)
    out[:, k + 5] = mean(width >= 12)
    out[:, k + 6] = mean(width == 1)
    out[:, k + 7] = mean(upper[starts])
    out[:, k + 8] = mean(upper[starts] & upper[stops - 1])
    out[:, k + 9] = mean(kinds[stops - 1] >= SIGNS)
    # Repetition by hashes: words, pairs and triples of words, and lines that the text has more than once.
    running = np.cumsum((data.astype(np.uint64) + np.uint64(17)) * _PLACES[_place(starts, len(data))])
    before = np.r_[np.uint64(0), running]
    words = _mixed(before[stops] - before[starts] + width.astype(np.uint64))
    for step in (1, 2, 3):
        n_grams = max(0, len(words) - step + 1)
        grams = words[:n_grams]
        for j in range(1, step):
            grams = _mixed(grams * np.uint64(31) + words[j : j + n_grams])
        whole = of_word[:n_grams] == of_word[step - 1 :][:n_grams]
        out[:, k + 9 + step] = _repeated_share(grams[whole], of_word[:n_grams][whole], n)
    lines = np.flatnonzero(opens | np.r_[False, data[:-1] == 10])
    line_ends = np.r_[lines[1:], len(data)]
    held = line_ends - lines > 1
    sums = _mixed(before[line_ends] - before[lines] + (line_ends - lines).astype(np.uint64))
    out[:, k + 13] = _repeated_share(sums[held], owner[lines][held], n)
    out[:, k + 14] = np.log1p(np.bincount(owner[lines][held], minlength=n))
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_PLACES = _mixed(np.arange(1, 33, dtype=np.uint64))


def _place(starts: np.ndarray, size: int) -> np.ndarray:
    """Place of every byte in its word, modulo 32."""
    begin = np.zeros(size, dtype=np.int64)
    begin[starts] = np.diff(starts, prepend=0)
    return (np.arange(size) - np.cumsum(begin)) % 32


def _repeated_share(keys: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Share of a text's keys that another one of the text equals before it in sorted order."""
    total = np.bincount(owner, minlength=n)
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    again = (k[1:] == k[:-1]) & (o[1:] == o[:-1])
    return np.bincount(o[1:][again], minlength=n) / np.maximum(total, 1)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def runs(batch: pa.RecordBatch, column: str, most: int = RUN_BYTES, rows: int = RUN_ROWS) -> Iterator[pa.RecordBatch]:
    """The batch in slices of ``rows`` rows whose texts have about ``most`` bytes; one longer text is a slice of its own."""
    _, offsets = text_buffers(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1)
        stop = min(stop, start + rows)
        yield batch.slice(start, stop - start)
        start = stop


@dataclass
class Trees:
    """Flattened trees: node i goes to child[i] when its feature is at most its threshold, else to child[i] + 1."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    value: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(DEPTH):
                inner = self.child[node] >= 0
                right = x[rows, self.feature[node]] > self.threshold[node]
                node = np.where(inner, self.child[node] + right, node)
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray) -> Trees:
    """Logistic boosting with second-order leaf values; no rows give the constant 0.5."""
    n, width = x.shape
    mean = (y.sum() + 1) / (n + 2)
    base = float(np.log(mean / (1 - mean)))
    feature, threshold, child, value, roots = [], [], [], [], []
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.zeros(0) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1) if n else np.zeros((0, width), int)
    margin = np.full(n, base)

    def new_node() -> int:
        feature.append(0), threshold.append(0.0), child.append(-1), value.append(0.0)
        return len(feature) - 1

    for _ in range(TREES if n and 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        root = new_node()
        roots.append(root)
        level, at = [root], np.full(n, root)
        for depth in range(DEPTH + 1):
            spot = {node: i for i, node in enumerate(level)}
            member = np.array([spot.get(a, -1) for a in range(len(feature))])[at]
            live = member >= 0
            if not live.any():
                break
            sums = np.zeros((3, len(level), width, BINS))
            for j in range(width):
                cell = member[live] * BINS + binned[live, j]
                for k, weight in enumerate((g[live], h[live], None)):
                    sums[k, :, j] = np.bincount(cell, weights=weight, minlength=len(level) * BINS).reshape(len(level), BINS)
            total = sums.sum(axis=3)[:, :, 0]
            left = np.cumsum(sums, axis=3)
            right = total[:, :, None, None] - left
            gain = left[0] ** 2 / (left[1] + RIDGE) + right[0] ** 2 / (right[1] + RIDGE)
            gain = np.where((left[2] >= LEAST_ROWS) & (right[2] >= LEAST_ROWS), gain, -np.inf)
            following = []
            for i, node in enumerate(level):
                value[node] = float(-RATE * total[0, i] / (total[1, i] + RIDGE))
                best = int(np.argmax(gain[i]))
                j, b = divmod(best, BINS)
                parent = total[0, i] ** 2 / (total[1, i] + RIDGE)
                if depth == DEPTH or not gain[i, j, b] > parent + 1e-9 or b >= len(cuts[j]):
                    continue
                feature[node], threshold[node] = j, float(cuts[j][b])
                child[node] = new_node()
                new_node()
                here = at == node
                at[here] = child[node] + (binned[here, j] > b)
                following += [child[node], child[node] + 1]
            level = following
        margin += np.array(value)[at]
    return Trees(base, np.array(roots, int), np.array(feature, int), np.array(threshold), np.array(child, int), np.array(value))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in runs(batch, "text"):
            x = statistics(*text_buffers(part.column("text")))
            values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column("label"), part.column("place"), values], names=["label", "place", "x"])


def fit(docs: DataFrame, labels: DataFrame, bound: int = TRAINING_ROWS) -> Trees:
    """Trees for ``labels(doc_id, quality)`` over the texts of ``docs``; held-out ids are never used.

    At most ``bound`` labelled rows, chosen by a hash of their id, are looked up, and of their texts at most
    twice as many, by a hash of the text where ids repeat; null labels and ids are left out, other labels than
    0 and 1 too. Without rows of both labels the score is a constant.
    """
    usable = labels.filter((remainder_of_id() != 2) & F.col("quality").isin(0, 1)).select("doc_id", "quality")
    sample = bounded_sample(usable, ["doc_id"], bound, usable.count())
    sample = sample.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("label"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = texts.join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))  # bounded by ``bound``
    known = known.select("label", F.xxhash64("_id", "text").alias("place"), "text")
    rows = known.mapInArrow(giving_back(_measured), "label int, place long, x array<double>").orderBy("place", "label").limit(2 * bound).toArrow()
    if not rows.num_rows:
        return fit_trees(np.zeros((0, FEATURES)), np.zeros(0))
    x = np.asarray(rows.column("x").combine_chunks().flatten()).reshape(-1, FEATURES)
    y = rows.column("label").to_numpy().astype(np.float64)
    order = np.lexsort([*x.T, y])  # the same model whatever the order of the rows
    return fit_trees(x[order], y[order])


def with_score(docs: DataFrame, trees: Trees, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with a ``score`` from 0 to 1 for every row; null and empty texts are scored as empty ones.

    Rows are scored one by one, so repeats get the same score and an empty table stays empty. A column
    named like the score is replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop(score)
    model = spark.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch, text):
                values = model.value.scores(statistics(*text_buffers(part.column(text))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values)], names=[*part.schema.names, score])

    schema = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())])
    return docs.mapInArrow(giving_back(run), schema)


def predicted(score: Column, threshold: float = THRESHOLD) -> Column:
    return (score >= threshold).cast("int")


def keep_good(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the trees accept, with the columns of ``docs``."""
    score = unused(docs, "_score")
    return with_score(docs, trees, "text", score).filter(F.col(score) >= threshold).drop(score)
