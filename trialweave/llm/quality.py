"""Quality of texts: histogram gradient-boosted trees over statistics of a document.

The statistics tell how a text is written, not what it says: shares of kinds of characters, lengths of words and lines, repetition. Training
sorts each statistic's values into bins once; a tree level is grown from sums of gradients by (node, statistic, bin). The trees are complete, so
that a forest is three arrays (statistic, threshold, leaf value) and all rows of a batch walk down all trees at once.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_batches, materialize

#: Distinct labelled texts drawn of each class at most, for training on the driver.
SAMPLE = 6000
TREES, DEPTH, BINS, RATE, RIDGE, LEAST_WEIGHT = 120, 4, 64, 0.1, 1.0, 4.0
#: Bytes of a text up to which it is compressed in one piece; longer ones in pieces of this size.
PACKED = 1 << 20

NAMES = [
    "chars", "words", "lower", "upper", "digit", "space", "stop", "symbol", "other", "control", "word_length", "longest_word", "distinct_words", "top_word", "repeated_next", "distinct_pairs", "single_signs",
    "plain_words", "capitalised", "marked_end", "lines", "line_words", "distinct_lines", "longest_line", "ended_lines", "packed",
]


def _classes() -> np.ndarray:
    """By byte: lower, upper, digit, space, end of a clause, symbol, beyond ASCII, control."""
    kind = np.full(256, 6)
    kind[:32], kind[127] = 7, 7
    kind[32:127] = 5
    for chars, k in ((range(97, 123), 0), (range(65, 91), 1), (range(48, 58), 2), (b" \t\n\r\x0b\x0c", 3), (b".,;:!?'\"-()", 4)):
        kind[list(chars)] = k
    return np.eye(8)[kind]


CLASSES = _classes()


def statistics(text: str | None) -> list[float]:
    """The values of NAMES; of a null or empty text all are 0."""
    words = (text or "").split()
    raw = (text or "").encode()
    n, w = len(text or ""), len(words)
    if not w:
        return [np.log1p(n), *[0.0] * (len(NAMES) - 1)]
    kinds = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ CLASSES / len(raw)
    count = Counter(words)
    pairs = Counter(zip(words, words[1:]))
    lines = [x for x in map(str.split, text.split("\n")) if x]
    sizes = list(map(len, lines))
    packed = sum(len(zlib.compress(raw[at : at + PACKED], 1)) for at in range(0, len(raw), PACKED))
    letters = sum(map(len, words))
    return [
        np.log1p(n), np.log1p(w), *kinds, letters / w, np.log1p(max(map(len, words))), len(count) / w, max(count.values()) / w,
        sum(c for (a, b), c in pairs.items() if a == b) / w, len(pairs) / w, sum(c for x, c in count.items() if len(x) == 1 and not x.isalnum()) / w,
        sum(c for x, c in count.items() if x.isalpha()) / w, sum(c for x, c in count.items() if x[0].isupper()) / w, sum(c for x, c in count.items() if not x[-1].isalnum()) / w,
        np.log1p(len(lines)), w / len(lines), len({tuple(x) for x in lines}) / len(lines), np.log1p(max(sizes)), sum(x[-1][-1] in ".!?" for x in lines) / len(lines), packed / len(raw),
    ]


def bin_edges(x: np.ndarray) -> list[np.ndarray]:
    """Of each statistic at most BINS - 1 values between its bins, at even ranks; a value on an edge is below it."""
    at = np.linspace(0, 1, BINS + 1)[1:-1]
    return [np.unique(np.quantile(column, at, method="inverted_cdf")) if len(column) else np.zeros(0) for column in x.T]


def fit_forest(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    """Logistic boosting of complete trees of DEPTH levels on weighted rows."""
    edges = bin_edges(x)
    binned = np.stack([np.searchsorted(e, column, "left") for e, column in zip(edges, x.T)], axis=1)  # a bin b holds values in (edge b-1, edge b]
    n, width = x.shape
    flat = binned + np.arange(width) * BINS
    bias = float(np.log(((weight * y).sum() + 0.5) / ((weight * (1 - y)).sum() + 0.5)))
    margin = np.full(n, bias)
    inner, leaves = (1 << DEPTH) - 1, 1 << DEPTH
    feature, threshold, value = np.zeros((TREES, inner), np.int32), np.full((TREES, inner), np.inf), np.zeros((TREES, leaves))
    for t in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (y - p), weight * p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            nodes, first = 1 << level, (1 << level) - 1
            key = (node - first)[:, None] * (width * BINS) + flat
            sums = [np.bincount(key.ravel(), np.repeat(v, width), nodes * width * BINS).reshape(nodes, width, BINS).cumsum(axis=2) for v in (g, h, weight)]
            below, total = sums, [s[:, :, -1:] for s in sums]
            part = lambda s, q: s**2 / (q + RIDGE)
            gain = part(below[0], below[1]) + part(total[0] - below[0], total[1] - below[1]) - part(total[0], total[1])
            gain[(below[2] < LEAST_WEIGHT) | (total[2] - below[2] < LEAST_WEIGHT)] = 0
            best = gain.reshape(nodes, -1).argmax(axis=1)
            for k, b in enumerate(best.tolist()):
                f, cut = divmod(b, BINS)
                if gain[k, f, cut] > 1e-9 and cut < len(edges[f]):  # else all rows of the node go to the left
                    feature[t, first + k], threshold[t, first + k] = f, edges[f][cut]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        leaf = node - inner
        value[t] = RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + RIDGE)
        margin += value[t][leaf]
    return {"bias": bias, "feature": feature, "threshold": threshold, "value": value}


def probability(forest: dict, x: np.ndarray) -> np.ndarray:
    """All rows walk down all trees, a level at a time."""
    feature, threshold, value = forest["feature"], forest["threshold"], forest["value"]
    tree, row = np.arange(len(feature))[None, :], np.arange(len(x))[:, None]
    node = np.zeros((len(x), len(feature)), np.int64)
    for _ in range((threshold.shape[1] + 1).bit_length() - 1):
        node = 2 * node + 1 + (x[row, feature[tree, node]] > threshold[tree, node])
    return 1 / (1 + np.exp(-(forest["bias"] + value[tree, node - threshold.shape[1]].sum(axis=1))))


def training_labels(labels: DataFrame) -> DataFrame:
    """Those whose id's crc32 isn't divisible by 5."""
    return labels.where(~held_out("doc_id", 5, 0))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """The forest of documents (doc_id, text) with labels (doc_id, quality); rows with a null id or label aren't used.

    At most `sample` distinct texts of each class are drawn, in the order of a hash of the text, and their statistics (not their texts) are gathered
    on the driver. A class's drawn texts weigh as much as all its distinct texts, so that the score is a probability. Copies of a text count once.
    Without labels of both classes the score of all texts is a constant.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", (F.col("quality") > 0).cast("int").alias("y"))
    hashed = docs.select("doc_id", F.xxhash64("text").alias("h"))
    distinct = materialize(hashed.join(known, "doc_id").groupBy("h", "y").agg(F.min("doc_id").alias("doc_id")), "labelled")
    number = {r.y: r["count"] for r in distinct.groupBy("y").count().collect()}
    drawn = [distinct.where(F.col("y") == y).orderBy("h").limit(sample) for y in (0, 1)]
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).join(F.broadcast(drawn[0].unionByName(drawn[1])), ["doc_id", "h"])
    found = _statistics(rows.dropDuplicates(["h", "y"]).select("y", "text"), "y int").limit(2 * sample).toArrow()
    y = found.column("y").to_numpy()
    x = np.array(found.column("x").to_pylist(), float).reshape(len(y), len(NAMES))
    order = np.lexsort([*x.T, y])  # the same forest whatever order the rows come in
    x, y = x[order], y[order]
    weight = np.ones(len(y))
    for c in (0, 1):
        if (y == c).any():
            weight[y == c] = number[c] / (y == c).sum() * len(y) / sum(number.values())
    if len(set(y.tolist())) < 2:
        return {"bias": 0.0 if not len(y) else 2.0 if y[0] else -2.0, "feature": np.zeros((0, 1), np.int32), "threshold": np.zeros((0, 1)), "value": np.zeros((0, 2))}
    return fit_forest(x, y.astype(float), weight)


def _statistics(rows: DataFrame, kept: str) -> DataFrame:
    def make():
        return lambda batch: [batch.column(0), [statistics(t) for t in batch.column(1).to_pylist()]]

    return map_batches(rows, make, f"{kept}, x array<double>")


def score(docs: DataFrame, forest: dict, threshold: float = 0.3) -> DataFrame:
    """doc_id, score (the probability of label 1) and predicted (1 from `threshold` on) of each row of (doc_id, text), whole texts.

    Null and empty texts have statistics of 0 and a score as others do. Rows are independent: repeated rows score alike, other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(forest)  # its size is fixed by TREES and DEPTH

    def make():
        own = sent.value

        def one(batch: pa.RecordBatch) -> list:
            p = probability(own, np.array([statistics(t) for t in batch.column(1).to_pylist()]))
            return [batch.column(0), p, (p >= threshold).astype(np.int32)]

        return one

    return map_batches(docs.select("doc_id", "text"), make, f"doc_id {dict(docs.dtypes)['doc_id']}, score double, predicted int")
